"""Flat guideline rules: a threshold table compiled to one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BIG = float("inf")
#: Density, new (None: either), size from, size below, solid component from and below (None: any; "missing"), category, rule, anchor.
THRESHOLDS = (
    ("calcified", None, 0, BIG, None, "2", "benign_density_category_2", "Benign attenuation pattern treated as Lung-RADS category 2 in minimal engine."),
    ("fat_containing", None, 0, BIG, None, "2", "benign_density_category_2", "Benign attenuation pattern treated as Lung-RADS category 2 in minimal engine."),
    ("solid", True, 0, 4, None, "2", "solid_new_lt4_category_2", "New solid nodule < 4 mm -> category 2 with annual screening."),
    ("solid", True, 4, 8, None, "3", "solid_new_4_to_7_category_3", "New solid nodule 4-7 mm -> category 3 with 6-month follow-up."),
    ("solid", True, 8, 15, None, "4A", "solid_new_8_to_14_category_4A", "New solid nodule 8-14 mm -> category 4A with diagnostic workup or short follow-up."),
    ("solid", True, 15, BIG, None, "4B", "solid_new_ge15_category_4B", "New solid nodule >= 15 mm -> category 4B with immediate workup."),
    ("solid", False, 0, 6, None, "2", "solid_lt6_category_2", "Solid nodule < 6 mm -> category 2 with annual screening."),
    ("solid", False, 6, 8, None, "3", "solid_6_to_7_category_3", "Solid nodule 6-7 mm -> category 3 with 6-month follow-up."),
    ("solid", False, 8, 15, None, "4A", "solid_8_to_14_category_4A", "Solid nodule 8-14 mm -> category 4A with 3-month follow-up or PET-CT."),
    ("solid", False, 15, BIG, None, "4B", "solid_ge15_category_4B", "Solid nodule >= 15 mm -> category 4B with immediate diagnostic action."),
    ("part_solid", True, 0, BIG, None, "3", "part_solid_new_category_3", "New part-solid nodule -> category 3 with 6-month follow-up."),
    ("part_solid", False, 0, 6, None, "2", "part_solid_lt6_category_2", "Part-solid nodule < 6 mm -> category 2 with annual screening."),
    ("part_solid", False, 6, BIG, "missing", "4A", "part_solid_missing_solid_component_conservative_4A", "Part-solid nodule >= 6 mm with missing solid component -> conservative category 4A fallback."),
    ("part_solid", False, 6, BIG, (0, 6), "3", "part_solid_ge6_solid_component_lt6_category_3", "Part-solid nodule >= 6 mm with solid component < 6 mm -> category 3."),
    ("part_solid", False, 6, BIG, (6, BIG), "4A", "part_solid_ge6_solid_component_ge6_category_4A", "Part-solid nodule >= 6 mm with solid component >= 6 mm -> category 4A."),
    ("ground_glass", True, 0, 30, None, "2", "ground_glass_new_lt30_category_2", "New ground-glass nodule < 30 mm -> category 2 with annual follow-up."),
    ("ground_glass", True, 30, BIG, None, "3", "ground_glass_new_ge30_category_3", "New ground-glass nodule >= 30 mm -> category 3 with 6-month follow-up."),
    ("ground_glass", False, 0, 30, None, "2", "ground_glass_lt30_category_2", "Ground-glass nodule < 30 mm -> category 2 with annual screening."),
    ("ground_glass", False, 30, BIG, None, "3", "ground_glass_ge30_category_3", "Ground-glass nodule >= 30 mm -> category 3 with 6-month follow-up."),
)
#: Category (with "+" for a new nodule), level, action, interval, modality.
ACTIONS = (
    ("2", "routine_screening", "继续 annual LDCT 筛查，12 个月后复查。", "12_months", "LDCT"),
    ("3", "short_interval_followup", "建议 6 个月后复查 LDCT。", "6_months", "LDCT"),
    ("4A+", "diagnostic_workup", "建议尽快进入诊断性评估，可行 PET-CT，并在 3 个月内完成复评。", "3_months", "PET_CT"),
    ("4A", "short_interval_followup", "建议 3 个月后复查 LDCT，必要时补充 PET-CT。", "3_months", "LDCT"),
    ("4B", "tissue_sampling", "建议立即进一步诊断评估，优先考虑组织取样或 PET-CT。", "immediate", "biopsy"),
)
#: Severity of a category, and the next one up.
SEVERITY = {"0": 0, "1": 1, "2": 2, "3": 3, "4A": 4, "4B": 5, "4X": 6, "S": 7}
STEP_UP = {"2": "3", "3": "4A", "4A": "4B"}
#: Remarks on missing or modifying facts.
NOTES = {
    "density_missing": "density_category 缺失或不明确，按 solid 路径保守处理。",
    "density_other": "density_category 超出最小规则集，按 solid 路径保守处理。",
    "component_missing": "part-solid 结节缺少 solid component，按保守 4A 处理。",
    "stable": "稳定至少 2 年，按类别 2 处理。",
    "increased": "存在增长证据，类别上调一级。",
    "decreased": "存在缩小证据，维持当前类别并提示改善。",
    "smoking_missing": "缺少 smoking_eligibility，不阻断规则，但限制风险分层解释。",
    "size_missing": "关键尺寸信息缺失，无法稳定进入 Lung-RADS 最小规则集。",
    "no_facts": "缺少足够结构化事实，当前只能返回 insufficient_data。",
}


def lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def kept(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def _row_matches(density: Column, new: Column, size: Column, component: Column, row: tuple) -> Column:
    want_density, want_new, low, high, part = row[:5]
    hit = (density == want_density) & (size < high if high != BIG else F.lit(True)) & (size >= low if low else F.lit(True))
    if want_new is not None:
        hit = hit & (new if want_new else ~new)
    if part == "missing":
        hit = hit & component.isNull()
    elif part:
        hit = hit & (component >= part[0]) & (component < part[1] if part[1] != BIG else F.lit(True))
    return F.coalesce(hit, F.lit(False))


KNOWN = ["solid", "part_solid", "ground_glass", "calcified", "fat_containing"]
#: What spelled() needs of a row that judged() made; all of it is narrow.
JUDGED = ("size_mm", "density_category", "change_status", "r_density", "r_new", "r_component", "r_row", "r_stable", "r_grown", "r_shrunk", "category", "severity")


def _pick(k: int) -> Column:
    return F.try_element_at(F.array(*[F.lit(r[k]) for r in THRESHOLDS]), F.col("r_row"))


def judged(nodules: DataFrame) -> DataFrame:
    """Adds to rows of nodules what their texts and sizes decide: threshold row, modifiers, category, severity."""
    d, known = F.col("density_category"), KNOWN
    n = nodules.withColumn("r_density", F.when(d.isin(known), d).otherwise("solid")).withColumn("r_new", F.coalesce(F.col("change_status") == "new", F.lit(False)))
    n = n.withColumn("r_component", F.when(F.col("r_density") == "part_solid", T.bound(F.array("density_text", "evidence_span", "recommendation_cue"), lambda t: T.solid_component(t[0], t[1], t[2]))))
    at = F
    for i, row in enumerate(THRESHOLDS):
        at = at.when(_row_matches(F.col("r_density"), F.col("r_new"), F.col("size_mm"), F.col("r_component"), row), F.lit(i + 1))
    n = n.withColumn("r_row", F.when(F.col("size_mm").isNotNull(), at))
    n = n.withColumn("r_base", _pick(5))
    stable = (F.col("change_status") == "stable") & T.two_years_stable(F.col("change_text"), F.col("evidence_span")) & F.col("r_base").isin("3", "4A")
    grown = (F.col("change_status") == "increased") & F.col("r_base").isin(*STEP_UP)
    n = n.withColumn("r_stable", F.coalesce(stable, F.lit(False))).withColumn("r_grown", F.coalesce(grown, F.lit(False)))
    n = n.withColumn("r_shrunk", F.coalesce((F.col("change_status") == "decreased") & F.col("r_base").isNotNull(), F.lit(False)))
    n = n.withColumn("category", F.when(F.col("r_stable"), "2").when(F.col("r_grown"), lookup(F.col("r_base"), STEP_UP)).otherwise(F.col("r_base")))
    return n.withColumn("severity", F.coalesce(lookup(F.col("category"), SEVERITY), F.lit(-1)))


def spelled(n: DataFrame, keep: list[str]) -> DataFrame:
    """keep and what is said of judged rows."""
    d, pick, known = F.col("density_category"), _pick, KNOWN
    action = F.when((F.col("category") == "4A") & F.col("r_new"), "4A+").otherwise(F.col("category"))
    n = n.withColumns({name: lookup(action, {a[0]: a[i] for a in ACTIONS}) for i, name in enumerate(("level", "action", "interval", "modality"), 1)})
    has_size = F.col("size_mm").isNotNull()
    no_part = F.coalesce(pick(4 + 2) == "part_solid_missing_solid_component_conservative_4A", F.lit(False))
    unsure = ~F.coalesce(d.isin(known), F.lit(False))
    return n.select(
        *keep,
        F.col("r_density").alias("density"),
        F.col("r_component").alias("solid_component_mm"),
        "category",
        "severity",
        "level", "action", "interval", "modality",
        pick(7).alias("anchor"),
        F.when(has_size, kept(pick(6), F.when(F.col("r_stable"), "stable_ge_2y_downgrade_to_2"), F.when(F.col("r_grown"), "growth_modifier_upgrade"), F.when(F.col("r_shrunk"), "decrease_modifier_maintain")))
        .otherwise(F.array(F.lit("fallback_missing_size"))).alias("triggered_rules"),
        F.when(has_size, kept(F.when(unsure, "density_category"), F.when(no_part, "solid_component_mm"))).otherwise(F.array(F.lit("nodule_size"))).alias("missing_information"),
        kept(
            F.when(d.isNull() | (d == "unclear"), NOTES["density_missing"]).when(unsure, NOTES["density_other"]),
            F.when(no_part, NOTES["component_missing"]), F.when(F.col("r_stable"), NOTES["stable"]),
            F.when(F.col("r_grown"), NOTES["increased"]), F.when(F.col("r_shrunk"), NOTES["decreased"]),
        ).alias("uncertainty_notes"),
    )


def evaluate(nodules: DataFrame) -> DataFrame:
    """Adds to rows of nodules: density, category, severity, level, action, interval, modality, anchor, rules, missing, notes.

    Needs size_mm, density_category, density_text, change_status, change_text, evidence_span, recommendation_cue."""
    return spelled(judged(nodules), nodules.columns)


def recommend(nodules: DataFrame, cases: DataFrame) -> DataFrame:
    """One recommendation per case. nodules: case_id, ordinal and a nodule's fields; cases: case_id and smoking_eligible (null: no smoking facts).

    The dominant nodule is the most severe, then the largest, then the first. Rows are judged and gathered without their
    texts; only what is dominant is spelled out."""
    top = judged(nodules).groupBy("case_id").agg(dominant(F.lit(True)).alias("d"), F.count("*").alias("nodule_count"))
    return recommended(cases.join(_spelled_top(top, ["case_id"]), "case_id", "left"))


def dominant(known: Column) -> Column:
    """Aggregate of judged rows (ordinal: the order of nodules): what spelled() needs of the most severe, then the largest, then the first of those known."""
    return F.max_by(F.struct(*JUDGED), F.when(known, F.struct("severity", F.coalesce("size_mm", F.lit(-1.0)).alias("s"), (-F.col("ordinal")).alias("o"))))


def _spelled_top(top: DataFrame, keep: list[str]) -> DataFrame:
    """keep, nodule_count and d, in which what is dominant is spelled out."""
    keep = [*keep, "nodule_count"]
    top = spelled(top.select(*keep, "d.*"), [*keep, "size_mm", "change_status"])
    return top.select(*keep, F.struct(*[c for c in top.columns if c not in keep]).alias("d"))


def recommend_dominant(top: DataFrame, keep: list[str]) -> DataFrame:
    """keep and recommend()'s columns of cases whose nodules are aggregated: case_id, smoking_eligible, nodule_count and d, their dominant()."""
    return recommended(_spelled_top(top, ["case_id", "smoking_eligible", *keep]), keep)


def recommended(out: DataFrame, keep: list[str] = ()) -> DataFrame:
    """keep and the recommendation of each case: case_id, smoking_eligible, nodule_count and d, the dominant nodule as it is spelled out (null: none)."""
    ok = F.col("d.size_mm").isNotNull()
    smoking = F.col("smoking_eligible")
    either = lambda a, b: F.when(ok, a).otherwise(b)
    risk = F.when(smoking == "eligible", "high_risk").when(smoking == "not_eligible", "not_high_risk").when(smoking.isNotNull(), "unknown")
    no_smoking = F.when(smoking.isNull(), "smoking_eligibility")
    gaps = F.array_distinct(F.array_compact(F.concat(either(F.col("d.missing_information"), F.array(F.lit("nodule_size"))), F.array(no_smoking))))
    remarks = F.array_distinct(F.array_compact(F.concat(F.col("d.uncertainty_notes"), F.array(F.when(smoking.isNull(), NOTES["smoking_missing"])))))
    return out.select(
        *keep,
        "case_id",
        either(F.col("d.level"), F.lit("insufficient_data")).alias("recommendation_level"),
        either(F.col("d.action"), F.lit(NOTES["no_facts"])).alias("recommendation_action"),
        F.when(ok, F.col("d.interval")).alias("followup_interval"),
        F.when(ok, F.col("d.modality")).alias("followup_modality"),
        F.when(ok, F.col("d.category")).alias("lung_rads_category"),
        F.lit("Lung-RADS_v2022").alias("guideline_source"),
        F.when(ok, F.col("d.anchor")).alias("guideline_anchor"),
        either(F.array_distinct("d.triggered_rules"), F.array(F.lit("fallback_insufficient_data"))).alias("triggered_rules"),
        F.struct(
            F.col("d.size_mm").alias("nodule_size_mm"), F.when(ok, F.col("d.density")).alias("nodule_density"), F.when(ok, F.col("nodule_count").cast("int")).alias("nodule_count"),
            F.when(ok, F.col("d.change_status")).alias("change_status"), F.when(ok, risk).alias("patient_risk_level"), smoking.alias("smoking_eligible"),
        ).alias("input_facts_used"),
        gaps.alias("missing_information"),
        either(F.nullif(F.array_join(remarks, " "), F.lit("")), F.lit(NOTES["size_missing"])).alias("uncertainty_note"),
        F.lit("rule_based").alias("output_type"),
    )
