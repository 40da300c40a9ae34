"""Schema rules as columns: every rule gives a message where it is broken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    path: str
    broken: Column
    message: str


def required(path: str) -> Rule:
    return Rule(path, F.col(path).isNull(), "is required")


def one_of(path: str, values: list[str]) -> Rule:
    return Rule(path, F.col(path).isNotNull() & ~F.col(path).isin(*values), f"is not one of {values}")


def matching(path: str, pattern: str) -> Rule:
    return Rule(path, F.col(path).isNotNull() & ~F.col(path).rlike(pattern), f"does not match {pattern}")


def at_least(path: str, least: float) -> Rule:
    return Rule(path, F.col(path) < least, f"is less than {least}")


def when(test: Column, then: Rule) -> Rule:
    return Rule(then.path, F.coalesce(test, F.lit(False)) & F.coalesce(then.broken, F.lit(False)), then.message)


def errors(rules: list[Rule]) -> Column:
    """Messages of the broken rules, by path."""
    texts = F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.lit(f"{r.path}: {r.message}")) for r in rules])
    return F.array_sort(F.array_compact(texts))


def validate(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    return rows.withColumn("errors", errors(rules)).withColumn("valid", F.size("errors") == 0)


def fact_rules() -> list[Rule]:
    return [
        required("note_id"), matching("note_id", r"^\d+-RR-\d+$"), required("subject_id"), at_least("subject_id", 1), at_least("nodule_count", 0),
        one_of("modality", ["CT", "CTA", "LDCT", "PET_CT", "MRI", "X-ray", "ultrasound", "other"]),
        one_of("body_site", ["chest", "abdomen", "pelvis", "chest_abdomen_pelvis", "other"]),
    ]


def bundle_rules() -> list[Rule]:
    quality, output = F.col("label_quality"), "recommendation_output"
    return [
        required("case_id"), matching("case_id", r"^CASE-[0-9]+-[0-9]+$"), one_of("label_quality", ["gold", "silver", "weak", "unlabeled"]),
        when(quality.isin("gold", "silver"), required(output)),
        when(quality.isin("weak", "unlabeled"), Rule(output, F.col(output).isNotNull(), "must be null")),
        when(quality == "unlabeled", Rule("smoking_eligibility", F.col("smoking_eligibility").isNotNull(), "must be null")),
    ]
