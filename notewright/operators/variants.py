"""Plainer variants of the extractors and of recommending, to compare the full ones with, and their union by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import radiology, smoking
from .cutting import cut


def _whole(notes: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    return notes.withColumn("found", T.mentions(t)).withColumn("cue", T.cue(t)).withColumn("nodule_count", F.size("found"))


def full_text_mentions(notes: DataFrame, text: str = "text") -> DataFrame:
    """The nodules of full_text_facts, a row each, in the columns of radiology.mention_facts; the notes' keys are those that notes has."""
    keys = [c for c in ("note_id", "subject_id", "exam_name") if c in notes.columns]
    found = cut(notes.select(*keys, text), (text,), text)
    return radiology.read_mentions(found.withColumn("nodule_count", F.size("found")).withColumn("rads", F.lit(None).cast("string")))


def full_text_facts(notes: DataFrame, text: str = "text") -> DataFrame:
    """Facts read from the whole report: no sections, no Lung-RADS category, mentions and cue of all of it."""
    t, staged = F.col(text), _whole(notes, text)
    none = F.lit(None).cast("string")
    return staged.select(
        *[c for c in notes.columns if c != text], t.alias("report_text"), T.modality(F.col("exam_name")).alias("modality"), T.body_site(F.col("exam_name")).alias("body_site"),
        F.struct(*[none.alias(k) for k in ("indication", "technique", "comparison", "findings", "impression")]).alias("sections"), "nodule_count",
        radiology.nodules(F.col("found"), F.col("nodule_count"), none, F.col("cue")).alias("nodules"),
    )


def social_history_facts(notes: DataFrame, text: str = "text") -> DataFrame:
    """Smoking facts of the section alone. Notes without one are unknown; a section's body has no header any more, so it is
    read as a note without the section would be."""
    body = T.social_history(F.col(text))
    return smoking.smoking_facts(notes.withColumn(text, F.coalesce(body, F.lit(""))))


def cue_recommendations(bundles: DataFrame) -> DataFrame:
    """Recommendations made of the first cue of a bundle's nodules (case_id, radiology_facts), by what it says."""
    cues = F.flatten(F.transform("radiology_facts", lambda f: F.transform(f["nodules"], lambda n: n["recommendation_cue"])))
    rows = bundles.select("case_id", F.try_element_at(F.filter(cues, lambda c: F.coalesce(c != "", F.lit(False))), F.lit(1)).alias("cue"))
    n, unit = T.group(F.col("cue"), r"(\d+)\s*(month|year|week)", 1), F.lower(T.group(F.col("cue"), r"(\d+)\s*(month|year|week)", 2))
    modality = F.when(T.has(F.col("cue"), r"\b(CT|LDCT|low.dose)\b"), "CT").when(T.has(F.col("cue"), r"\b(PET|PET.CT)\b"), "PET-CT")
    none = F.col("cue").isNull()
    return rows.select(
        "case_id", F.when(none, "insufficient_data").otherwise("actionable").alias("recommendation_level"), F.col("cue").alias("recommendation_action"),
        F.concat(n, F.lit(" "), unit, F.when(n.try_cast("long") > 1, "s").otherwise("")).alias("followup_interval"), modality.alias("followup_modality"), F.lit(None).cast("string").alias("lung_rads_category"),
        F.lit("cue_extraction_only").alias("guideline_source"), F.lit(None).cast("string").alias("guideline_anchor"),
        F.when(none, F.array(F.lit("no_recommendation_cue_found"))).otherwise(F.array(F.lit("extracted_recommendation_cue"), F.concat(F.lit("cue_text="), F.left("cue", F.lit(100))))).alias("reasoning_path"),
        F.when(none, F.array().cast("array<string>")).otherwise(F.array(F.lit("cue_extraction"))).alias("triggered_rules"),
        F.when(none, F.array(F.lit("recommendation_cue"))).otherwise(F.array().cast("array<string>")).alias("missing_information"),
        F.when(none, "No recommendation cue found in report text.").otherwise("Recommendation derived from report cue text only, no structured rule applied.").alias("uncertainty_note"), F.lit("cue_based").alias("output_type"),
    )


def tagged(variants: dict[str, DataFrame]) -> DataFrame:
    """The rows of all variants with the name of each, columns by name."""
    out = None
    for name, df in variants.items():
        one = df.withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
