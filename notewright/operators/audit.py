"""Audit tables: scores of reviewed rows by group, completeness checks, reasons of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import rate


def filled(c: Column) -> Column:
    """Neither null nor blank nor the word None."""
    t = F.trim(c.cast("string"))
    return c.isNotNull() & (t != "") & (t != "None")


def completion(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, rows, filled, rate: one pass, a row for each field."""
    one = rows.agg(F.count("*").alias("rows"), *[F.count_if(filled(F.col(f))).alias(f"f{i}") for i, f in enumerate(fields)])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("filled")) for i, f in enumerate(fields)])
    return one.select("rows", F.inline(cells)).select("field", "rows", "filled", F.coalesce(F.try_divide("filled", "rows"), F.lit(0.0)).alias("rate"))


def scores(rows: DataFrame, fields: list[str], groups: str) -> DataFrame:
    """audit_group, field, judged, correct_rate. groups holds names piped together, and a row counts in each of them; what is uncertain is not judged."""
    each = rows.withColumn("audit_group", F.explode(F.filter(F.split(F.coalesce(groups, F.lit("")), r"\|"), lambda g: g != "")))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.trim(f)).alias("verdict")) for f in fields])
    long = each.select("audit_group", F.inline(cells))
    judged = F.col("verdict").isin("correct", "incorrect")
    return long.groupBy("audit_group", "field").agg(F.count_if(judged).alias("judged"), rate(F.col("verdict") == "correct", judged).alias("correct_rate"))


def invalid_values(rows: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    """key, field, value of every value that is not allowed; blank ones are."""
    cells = F.array(*[F.when(filled(F.col(f)) & ~F.col(f).isin(*v), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))) for f, v in allowed.items()])
    return rows.select(key, F.inline(F.array_compact(cells)))


def checks(rows: DataFrame, key: str, tests: dict[str, Column], examples: int = 3) -> DataFrame:
    """name, status, failures, examples (least keys) of each test that must hold; one pass."""
    aggs = []
    for i, test in enumerate(tests.values()):
        bad = ~F.coalesce(test, F.lit(False))
        aggs += [F.count_if(bad).alias(f"n{i}"), F.min(F.when(bad, F.col(key))).alias(f"x{i}")]
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"n{i}").alias("failures"), F.col(f"x{i}").cast("string").alias("first_example")) for i, n in enumerate(tests)])
    return rows.agg(*aggs).select(F.inline(cells)).select("name", F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"), "failures", "first_example")


def candidate_counts(nodules: DataFrame) -> DataFrame:
    """case_id and numbers of candidates: all, with size, with density, with both, with one alone."""
    size, density = F.col("size_mm").isNotNull(), F.coalesce(F.col("density").isin("solid", "part_solid", "ground_glass", "calcified", "fat_containing"), F.lit(False))
    return nodules.groupBy("case_id").agg(
        F.count("*").alias("candidates"), F.count_if(size).alias("with_size"), F.count_if(density).alias("with_density"), F.count_if(size & density).alias("with_both"),
        F.count_if(size & ~density).alias("size_alone"), F.count_if(density & ~size).alias("density_alone"),
    )


def root_cause(counts: DataFrame) -> DataFrame:
    """Why a case would abstain, from its candidate counts."""
    c = F.col
    cause = (
        F.when(c("candidates") == 0, "no_structured_nodule").when(c("with_both") > 0, "actionable").when((c("size_alone") > 0) & (c("density_alone") > 0), "split_across_candidates")
        .when(c("with_size") > 0, "density_never_stated").when(c("with_density") > 0, "size_never_stated").otherwise("neither_stated")
    )
    return counts.withColumn("root_cause", cause)
