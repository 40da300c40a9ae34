"""Evaluation of facts, smoking histories, recommendations and bundles: rates over all, and against explicit labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues
from .metrics import rate

#: Levels of a recommendation by what they ask for.
ACTIONABLE = ("actionable", "short_interval_followup", "tissue_sampling", "diagnostic_workup")
MONITORING = ("monitoring", "routine_screening")


def _clear(c: Column) -> Column:
    return F.coalesce(c != "unclear", F.lit(False))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _count(array: Column, test) -> Column:
    return F.coalesce(F.size(F.filter(array, test)), F.lit(0))


FIELDS = ("size_mm", "density_category", "location_lobe", "change_status", "recommendation_cue")


def _field_hits(nodules: Column) -> dict[str, Column]:
    stated = lambda c: _count(nodules, lambda n: n[c].isNotNull())
    clear = lambda c: _count(nodules, lambda n: _clear(n[c]))
    return {c: (stated if c in ("size_mm", "recommendation_cue") else clear)(c) for c in FIELDS}


def radiology_evaluation(facts: DataFrame, valid: Column | None = None) -> DataFrame:
    """One row over notes (nodule_count, nodules): how many have nodules, and how much of each field is read; one pass.

    A nodule_count that is null or negative is the number of nodules. valid: whether a note's schema holds."""
    nodules = F.coalesce("nodules", F.array())
    n = F.when(F.col("nodule_count") >= 0, F.col("nodule_count")).otherwise(F.size(nodules)).cast("long")
    hits = _field_hits(F.col("nodules"))
    rows = facts.select(n.alias("n"), F.size(nodules).cast("long").alias("listed"), (F.lit(True) if valid is None else valid).alias("valid"), *[h.cast("long").alias(f"h_{c}") for c, h in hits.items()])
    one = rows.agg(
        F.count("*").alias("total_notes"), rate(F.col("valid")).alias("schema_valid_rate"), rate(F.col("listed") > 0).alias("note_level_success_rate"), rate(F.col("n") > 0).alias("nodule_detect_rate"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_nodules_per_note"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_nodules"), F.sum("listed").alias("all"), *[F.sum(f"h_{c}").alias(f"h_{c}") for c in FIELDS],
    )
    return one.select(*[c for c in one.columns if c != "all" and not c.startswith("h_")], *[_ratio(F.col(f"h_{c}"), F.col("all")).alias(f"{c}_extract_rate") for c in FIELDS])


def explicit_agreement(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: for each field of labels (note_id and any of size_mm, density_category, location_lobe, change_status) the rate of
    labelled notes whose first nodule agrees, sizes within half a millimetre. A note without facts is a miss."""
    first = facts.select("note_id", F.try_element_at("nodules", F.lit(1)).alias("x"))
    first = first.groupBy("note_id").agg(F.first("x").alias("x"))
    fields = [c for c in ("size_mm", "density_category", "location_lobe", "change_status") if c in labels.columns]
    j = labels.select("note_id", *[F.col(c).alias(f"l_{c}") for c in fields]).join(first, "note_id", "left")

    def agrees(c: str) -> Column:
        if c == "size_mm":
            return F.coalesce(F.abs(F.col("x.size_mm") - F.col("l_size_mm")) <= 0.5, F.lit(False)) | (F.col("x.size_mm").isNull() & F.col("l_size_mm").isNull())
        return F.col(f"x.{c}").eqNullSafe(F.col(f"l_{c}"))

    return j.agg(F.count("*").alias("labelled"), *[rate(agrees(c)).alias(f"explicit_{c}_rate") for c in fields])


#: What a status is called.
STATUS = {"current_smoker": "current", "current": "current", "former_smoker": "former", "former": "former", "never_smoker": "never", "never": "never"}


def smoking_label(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), status), F.lit("unknown"))


def smoking_evaluation(facts: DataFrame, valid: Column | None = None) -> DataFrame:
    """One row over smoking facts; rates of amounts are among known statuses, that of quitting among former smokers."""
    status = smoking_label(F.col("smoking_status_norm"))
    known, former, section = status != "unknown", status == "former", F.coalesce(F.col("source_section") == "Social History", F.lit(False))
    note = F.lower(F.coalesce("data_quality_notes", F.lit("")))
    has = lambda c: F.col(c).isNotNull()
    return facts.agg(
        F.count("*").alias("total_notes"), rate(F.lit(True) if valid is None else valid).alias("schema_valid_rate"), rate(known).alias("non_unknown_rate"), rate(~known).alias("unknown_rate"),
        rate(F.coalesce("ever_smoker_flag", F.lit(False)), known).alias("ever_smoker_rate"), rate(F.coalesce(F.col("eligible_for_high_risk_screening") == "eligible", F.lit(False)), known).alias("eligible_rate"),
        rate(~section).alias("fallback_trigger_rate"), rate(section).alias("social_history_only_rate"), rate(has("pack_year_value"), known).alias("pack_year_parse_rate"), rate(has("ppd_value"), known).alias("ppd_parse_rate"),
        rate(has("years_smoked_value"), known).alias("years_smoked_parse_rate"), rate(has("quit_years_value"), former).alias("quit_years_parse_rate"),
        F.count_if(~has("ppd_value") & has("ppd_text")).alias("ppd_ambiguity_protected_count"), rate(note.contains("de-identified") | note.contains("deidentified")).alias("deidentified_rate"),
    )


def smoking_agreement(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: agreement with labels (note_id, status, pack_year_value, ppd_value; null: not labelled), pack-years within 1 and
    packs a day within 0.1. Notes without facts are left out."""
    last = facts.groupBy("note_id").agg(F.last(F.struct("smoking_status_norm", "pack_year_value", "ppd_value")).alias("x"))
    j = labels.select("note_id", F.col("status").alias("l_status"), F.col("pack_year_value").alias("l_pack"), F.col("ppd_value").alias("l_ppd")).join(last, "note_id")
    near = lambda a, b, by: F.coalesce(F.abs(a - b) <= by, F.lit(False))
    of = lambda c: F.col(c).isNotNull()
    return j.agg(
        F.count("*").alias("labelled"), rate(smoking_label(F.col("x.smoking_status_norm")) == smoking_label(F.col("l_status")), of("l_status")).alias("explicit_status_accuracy"),
        rate(near(F.col("x.pack_year_value"), F.col("l_pack"), 1.0), of("l_pack")).alias("explicit_pack_year_accuracy"), rate(near(F.col("x.ppd_value"), F.col("l_ppd"), 0.1), of("l_ppd")).alias("explicit_ppd_accuracy"),
    )


def recommendation_evaluation(recs: DataFrame, valid: Column | None = None) -> DataFrame:
    """One row over recommendations: rates of levels and of what explains them."""
    level = F.coalesce("recommendation_level", F.lit(""))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False)) if c in recs.columns else F.lit(False)
    return recs.agg(
        F.count("*").alias("total_recommendations"), rate(F.lit(True) if valid is None else valid).alias("schema_valid_rate"), rate(level.isin(*ACTIONABLE)).alias("actionable_rate"), rate(level.isin(*MONITORING)).alias("monitoring_rate"),
        rate(level == "insufficient_data").alias("insufficient_data_rate"), rate(F.trim(F.coalesce(F.col("guideline_anchor").cast("string"), F.lit(""))) != "").alias("guideline_anchor_presence_rate"),
        rate(some("reasoning_path")).alias("reasoning_path_nonempty_rate"), rate(some("triggered_rules")).alias("triggered_rules_nonempty_rate"),
        F.coalesce(F.avg(F.size(F.coalesce("missing_information", F.array().cast("array<string>")))), F.lit(0.0)).alias("avg_missing_fields"),
    )


def levels_by(recs: DataFrame, key: Column, name: str = "density") -> DataFrame:
    """name, recommendation_level, n: how often each level occurs for each value of the key, null too."""
    return recs.groupBy(key.alias(name), "recommendation_level").agg(F.count("*").alias("n"))


def recommendation_agreement(recs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: how often all key terms of a labelled cue are in the action, and how often the labelled category is given.

    labels: case_id, cue, category (null: not labelled). Cases without a recommendation are left out."""
    j = labels.select("case_id", F.col("cue").alias("l_cue"), F.col("category").alias("l_category")).join(recs.select("case_id", "recommendation_action", "lung_rads_category"), "case_id")
    cue = cues.agrees(F.col("recommendation_action"), F.col("l_cue"))
    return j.agg(
        F.count("*").alias("labelled"), rate(cue, F.col("l_cue").isNotNull()).alias("explicit_cue_agreement_rate"),
        rate(F.coalesce(F.col("lung_rads_category") == F.col("l_category"), F.lit(False)), F.col("l_category").isNotNull()).alias("rule_agreement_rate"),
    )


def bundle_evaluation(bundles: DataFrame, valid: Column | None = None) -> DataFrame:
    """One row over bundles: what is complete, and how much there is on average."""
    d, p, t = "demographics", "provenance", "recommendation_target"
    has = lambda c: F.col(c).isNotNull()
    output = has("recommendation_output") if "recommendation_output" in bundles.columns else F.lit(False)
    ids = F.coalesce(F.size(f"{p}.radiology_note_ids") > 0, F.lit(False))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    nodules = F.coalesce(F.aggregate("radiology_facts", F.lit(0), lambda a, f: a + F.coalesce(F.size(f["nodules"]), F.lit(0))), F.lit(0))
    return bundles.agg(
        F.count("*").alias("total_bundles"), rate(F.lit(True) if valid is None else valid).alias("schema_valid_rate"), rate(size("radiology_facts") > 0).alias("bundle_with_radiology_rate"), rate(has("smoking_eligibility")).alias("bundle_with_smoking_rate"),
        rate(output).alias("bundle_with_recommendation_rate"), rate(has(f"{d}.age") | has(f"{d}.sex") | has(f"{d}.race")).alias("bundle_with_demographics_rate"),
        rate(ids & has(f"{p}.data_version") & has(f"{p}.pipeline_version")).alias("provenance_complete_rate"), rate(has(f"{p}.discharge_note_id")).alias("has_discharge_note_rate"),
        rate(has(f"{t}.ground_truth_action")).alias("ground_truth_action_present_rate"), rate(has(f"{d}.age")).alias("demographics_age_present_rate"), rate(has(f"{d}.sex")).alias("demographics_sex_present_rate"),
        mean(size(f"{d}.missing_flags")).alias("avg_demographics_missing_fields"), mean(size("radiology_facts")).alias("avg_radiology_facts_per_bundle"), mean(nodules).alias("avg_nodules_per_bundle"),
    )
