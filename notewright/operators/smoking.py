"""Discharge notes to smoking history and screening eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

#: Eligibility by status, least pack-years and most years since quitting, with its reason.
REASONS = {
    "never": "Never smoker based on note evidence.",
    "current_missing": "Current smoker but pack-year exposure is missing.",
    "current_yes": "Current smoker with >=20 pack-years; age still needs external confirmation.",
    "current_no": "Current smoker but documented pack-years are below 20.",
    "former_missing": "Former smoker but pack-years or years since quitting are incomplete.",
    "former_yes": "Former smoker with >=20 pack-years and quit within 15 years; age still needs external confirmation.",
    "former_no": "Former smoker but pack-years <20 or quit >15 years ago.",
    "unknown": "Smoking history is unknown or insufficient for eligibility determination.",
}
LEAST_PACK_YEARS, MOST_QUIT_YEARS = 20, 15


def eligibility(status: Column, pack_years: Column, quit_years: Column) -> Column:
    """(value, reason)."""
    enough = pack_years >= LEAST_PACK_YEARS
    current, former = status == "current_smoker", status == "former_smoker"
    rows = [
        (status == "never_smoker", "not_eligible", "never"),
        (current & pack_years.isNull(), "unknown", "current_missing"),
        (current & enough, "eligible", "current_yes"),
        (current, "not_eligible", "current_no"),
        (former & (pack_years.isNull() | quit_years.isNull()), "unknown", "former_missing"),
        (former & enough & (quit_years <= MOST_QUIT_YEARS), "eligible", "former_yes"),
        (former, "not_eligible", "former_no"),
    ]
    value = reason = F
    for hit, v, r in rows:
        value, reason = value.when(hit, F.lit(v)), reason.when(hit, F.lit(REASONS[r]))
    return F.struct(value.otherwise("unknown").alias("value"), reason.otherwise(REASONS["unknown"]).alias("reason"))


def evidence_quality(status_span: Column, pack_years: Column, ppd: Column, years: Column, source: Column) -> Column:
    numbers = pack_years.isNotNull() | (ppd.isNotNull() & years.isNotNull())
    return (
        F.when(T.deidentified(source), "none")
        .when(status_span.isNotNull() & numbers, "high")
        .when(T.has(status_span, P.LOW_EVIDENCE), "low")
        .when(status_span.isNotNull(), "medium")
        .when(pack_years.isNotNull() | ppd.isNotNull() | years.isNotNull(), "low")
        .otherwise("none")
    )


def smoking_facts(notes: DataFrame, text: str = "text") -> DataFrame:
    """subject_id, note_id and the fields of smoking history of each discharge note."""
    t = F.col(text)
    d = notes.withColumn("social", T.social_history(t)).withColumn("has_section", T.has_social_history(t))
    d = d.withColumn("usable", F.col("social").isNotNull() & ~T.deidentified(F.col("social")))
    d = d.withColumn("rest", F.when(~F.col("usable"), T.smoking_sentences(t)))
    d = d.withColumn("fallback", F.col("rest").isNotNull())
    d = d.withColumn("target", F.when(F.col("usable"), F.col("social")).otherwise(F.coalesce("rest", F.lit(""))))
    g = F.col("target")
    d = d.withColumn("st", T.smoking_status(g)).withColumn("py", T.pack_years(g)).withColumn("pp", T.ppd(g)).withColumn("ys", T.years_smoked(g)).withColumn("qy", T.quit_years(g))
    product = F.col("pp.value") * F.col("ys.value")
    d = d.withColumn("pack_year_value", F.coalesce("py.value", product)).withColumn("computed", F.col("py.value").isNull() & product.isNotNull())
    d = d.withColumn("el", eligibility(F.col("st.value"), F.col("pack_year_value"), F.col("qy.value")))
    quality = evidence_quality(F.col("st.span"), F.col("pack_year_value"), F.col("pp.value"), F.col("ys.value"), F.when(F.col("fallback"), g).otherwise(F.col("social")))
    section = F.when(F.col("fallback"), "full_text_fallback").when(F.col("has_section"), "Social History")
    origin = (
        F.when(F.col("fallback"), "Social History missing or de-identified; used full-text fallback.")
        .when(section.isNull(), "Social History section not found.")
        .when(~F.col("usable"), "Social History appears de-identified.")
    )
    remarks = F.nullif(F.concat_ws(" ", origin, F.when(F.col("computed"), "pack_year_value computed from ppd_value and years_smoked_value.")), F.lit(""))
    out = d.select(
        "subject_id",
        "note_id",
        *([c for c in ("ordinal",) if c in notes.columns]),
        section.alias("source_section"),
        F.col("st.span").alias("smoking_status_raw"),
        F.col("st.value").alias("smoking_status_norm"),
        "pack_year_value",
        F.col("py.span").alias("pack_year_text"),
        F.col("pp.value").alias("ppd_value"),
        F.col("pp.span").alias("ppd_text"),
        F.col("ys.value").alias("years_smoked_value"),
        F.col("ys.span").alias("years_smoked_text"),
        F.col("qy.value").alias("quit_years_value"),
        F.col("qy.span").alias("quit_years_text"),
        F.coalesce("st.span", "py.span", "pp.span", "ys.span", "qy.span").alias("evidence_span"),
        F.when(F.col("st.value").isin("current_smoker", "former_smoker"), True).when(F.col("st.value") == "never_smoker", False).alias("ever_smoker_flag"),
        F.col("el.value").alias("eligible_for_high_risk_screening"),
        F.lit("USPSTF_2021").alias("eligibility_criteria_applied"),
        F.col("el.reason").alias("eligibility_reason"),
        F.when(F.col("fallback") & quality.isin("high", "medium"), "low").otherwise(quality).alias("evidence_quality"),
        remarks.alias("data_quality_notes"),
    )
    watched = (
        "source_section", "smoking_status_raw", "pack_year_value", "pack_year_text", "ppd_value", "ppd_text", "years_smoked_value", "years_smoked_text",
        "quit_years_value", "quit_years_text", "evidence_span", "ever_smoker_flag", "eligibility_criteria_applied", "eligibility_reason", "data_quality_notes",
    )
    return out.withColumn("missing_flags", T.missing(**{c: F.col(c) for c in watched}))
