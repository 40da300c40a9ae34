"""Per-subject case bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The synonyms of a sex.
SEX = {"m": "M", "male": "M", "f": "F", "female": "F", "unknown": "unknown", "unk": "unknown", "other": "unknown"}
GOOD_SMOKING = ("high", "medium", "strong", "moderate")


def sex(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEX.items() for x in kv]), F.lower(T.strip(c))), c)


def first_per_subject(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Each subject's first row by ordinal, from a partial aggregation."""
    return rows.groupBy("subject_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "subject_id"]), ordinal).alias("r")).select("subject_id", "r.*")


def _cued(n) -> Column:
    return F.coalesce(n["recommendation_cue"] != "", F.lit(False))


def _informs(n) -> Column:
    clear = F.coalesce(n["density_category"] != "unclear", F.lit(False))
    return n["size_mm"].isNotNull() | clear | _cued(n) | F.coalesce(n["confidence"].isin("medium", "high"), F.lit(False))


def _sure(n) -> Column:
    return F.coalesce(n["confidence"] == "high", F.lit(False)) & n["size_mm"].isNotNull()


def _label(signal: Column, sure: Column, cued: Column, smoking_quality: Column) -> Column:
    silver = sure & cued & F.coalesce(F.lower(smoking_quality).isin(*GOOD_SMOKING), F.lit(False))
    return F.when(~F.coalesce(signal, F.lit(False)), "unlabeled").when(silver, "silver").otherwise("weak")


def label_quality(nodules: Column, smoking_quality: Column) -> Column:
    """unlabeled, silver or weak. nodules: array of nodule structs (null: none); smoking_quality null without smoking facts."""
    return _label(F.exists(nodules, _informs), F.exists(nodules, _sure), F.exists(nodules, _cued), smoking_quality)


def case_id() -> Column:
    return F.concat(F.lit("CASE-"), F.col("subject_id"), F.lit("-001"))


def labelled(mentions: DataFrame, smoking: DataFrame, **more: Column) -> DataFrame:
    """case_id, label_quality and smoking_eligibility of assemble(), and aggregates of a subject's mentions, of which none is gathered.

    mentions: subject_id and a nodule's fields, a row of nulls for a note without nodules."""
    n = {k: F.col(k) for k in ("size_mm", "density_category", "confidence", "recommendation_cue")}
    of = {"signal": F.bool_or(_informs(n)), "sure": F.bool_or(_sure(n)), "cued": F.bool_or(_cued(n))}
    b = mentions.groupBy("subject_id").agg(*[c.alias(k) for k, c in (of | more).items()]).join(smoking_of(smoking), "subject_id", "left")
    b = b.withColumn("label_quality", _label(F.col("signal"), F.col("sure"), F.col("cued"), F.col("smoking_eligibility.evidence_quality")))
    kept = F.when(F.col("label_quality") != "unlabeled", F.col("smoking_eligibility"))
    return b.select(case_id().alias("case_id"), "label_quality", kept.alias("smoking_eligibility"), *more)


def smoking_of(smoking: DataFrame) -> DataFrame:
    return smoking.select("subject_id", F.struct(*[c for c in smoking.columns if c not in ("subject_id", "ordinal")]).alias("smoking_eligibility"))


def assemble(facts: DataFrame, smoking: DataFrame, demographics: DataFrame, *, pipeline_version: str = "0.1.0", data_version: str = "notes-1") -> DataFrame:
    """One bundle per subject of facts (note_id, subject_id, ordinal, nodules, ...), in the order of ordinal.

    A subject's facts are gathered, which its number of notes bounds; smoking (one row a subject) and
    demographics are joined on the left. The case identifier and provenance follow the subject."""
    of_note = F.struct("ordinal", F.struct(*[c for c in facts.columns if c not in ("subject_id", "ordinal")]).alias("fact"))
    grouped = facts.groupBy("subject_id").agg(F.array_sort(F.collect_list(of_note)).alias("f"))
    grouped = grouped.select("subject_id", F.transform("f", lambda x: x["fact"]).alias("radiology_facts"))
    who = demographics.select("subject_id", *[F.col(c).alias(f"d_{c}") for c in ("age", "sex", "race", "insurance", "source")]).withColumn("d_sex", sex(F.col("d_sex")))
    b = grouped.join(smoking_of(smoking), "subject_id", "left").join(who, "subject_id", "left")
    b = b.withColumn("all", F.flatten(F.transform("radiology_facts", lambda f: f["nodules"])))
    b = b.withColumn("label_quality", label_quality(F.col("all"), F.col("smoking_eligibility.evidence_quality")))
    cue = F.try_element_at(F.filter(F.transform("all", lambda n: n["recommendation_cue"]), lambda c: F.coalesce(c != "", F.lit(False))), F.lit(1))
    labelled = F.col("label_quality") != "unlabeled"
    b = b.withColumn("action", F.when(labelled, cue)).withColumn("smoking_eligibility", F.when(labelled, F.col("smoking_eligibility")))
    keys = ("age", "sex", "race", "insurance", "source")
    note_ids = F.array_distinct(F.filter(F.transform("radiology_facts", lambda f: f["note_id"]), lambda x: F.coalesce(x != "", F.lit(False))))
    return b.select(
        case_id().alias("case_id"), "subject_id",
        F.struct(*[F.col(f"d_{k}").alias(k) for k in keys], T.missing(**{k: F.col(f"d_{k}") for k in keys}).alias("missing_flags")).alias("demographics"),
        "radiology_facts", "smoking_eligibility",
        F.struct(F.col("action").alias("ground_truth_action"), F.when(F.col("action").isNotNull(), "extracted_from_report").otherwise("none").alias("ground_truth_source")).alias("recommendation_target"),
        F.struct(note_ids.alias("radiology_note_ids"), F.col("smoking_eligibility.note_id").alias("discharge_note_id"), F.lit(data_version).alias("data_version"), F.lit(pipeline_version).alias("pipeline_version")).alias("provenance"),
        F.lit("unlabeled").alias("split"), "label_quality",
    )


def downgraded(bundles: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Silver bundles get their recommendation; without one that says something they are weak."""
    r = recommendations.select("case_id", F.struct(*[c for c in recommendations.columns if c != "case_id"]).alias("recommendation_output"))
    return downgrade(bundles.join(r, "case_id", "left"))


def downgrade(j: DataFrame) -> DataFrame:
    """downgraded() of bundles that have a recommendation_output already."""
    silver = F.col("label_quality") == "silver"
    empty = F.coalesce(F.col("recommendation_output.recommendation_level"), F.lit("insufficient_data")) == "insufficient_data"
    return j.withColumn("recommendation_output", F.when(silver & ~empty, F.col("recommendation_output"))).withColumn("label_quality", F.when(silver & empty, "weak").otherwise(F.col("label_quality")))


def case_nodules(bundles: DataFrame) -> DataFrame:
    """Rows case_id, note_id, ordinal and a nodule's fields."""
    notes = bundles.select("case_id", F.posexplode("radiology_facts").alias("i", "f"))
    rows = notes.select("case_id", F.col("f.note_id").alias("note_id"), "i", F.posexplode("f.nodules").alias("j", "n"))
    return rows.select("case_id", "note_id", (F.col("i") * 100_000 + F.col("j")).alias("ordinal"), "n.*")
