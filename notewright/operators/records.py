"""Rows re-shaped for training, gold review and reports: label normalisation, records by task, mismatch classes, coverage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .metrics import rate
from .sampling import top_or_other

#: The labels of each task.
DENSITIES = ("solid", "part_solid", "ground_glass", "calcified", "unclear")
LOCATIONS = ("RUL", "RML", "RLL", "LUL", "LLL", "lingula", "bilateral", "unclear", "no_location")


def density_label(c: Column) -> Column:
    return F.when(c.isin(*DENSITIES), c).otherwise("unclear")


def location_label(c: Column, *, spelled: bool = False) -> Column:
    """Null is no_location, what is no label unclear. spelled: case and blanks do not matter, and empty and none are no_location too."""
    if not spelled:
        return F.when(c.isin(*LOCATIONS), c).when(c.isNull(), "no_location").otherwise("unclear")
    t = F.lower(T.strip(c))
    named = F.try_element_at(F.create_map(*[F.lit(x) for k in LOCATIONS for x in (k.lower(), k)]), t)
    return F.when(c.isNull() | t.isin("", "none"), "no_location").otherwise(F.coalesce(named, F.lit("unclear")))


def gold_label(task: str) -> Column:
    """The label of a mention row by task."""
    if task == "density":
        return F.coalesce(F.nullif("density_label", F.lit("")), F.lit("unclear"))
    if task == "size":
        return F.when(F.coalesce("has_size", F.lit(False)), "has_size").otherwise("no_size")
    return location_label(F.col("location_label"))


def original_label(task: str) -> Column:
    """The label that rules gave a mention, as weak labels are compared with it."""
    return {"density": F.coalesce("density_label", F.lit("unclear")), "size": F.coalesce("has_size", F.lit(False)).cast("string"), "location": F.coalesce("location_label", F.lit("no_location"))}[task]


def mention_quality(density: Column, density_text: Column, size: Column, size_text: Column, location: Column, location_text: Column) -> Column:
    """explicit: all three stated with their text; silver: the text of one; weak: none."""
    every = (density != "unclear") & density_text.isNotNull() & size.isNotNull() & size_text.isNotNull() & location.isNotNull() & location_text.isNotNull()
    some = density_text.isNotNull() | size_text.isNotNull() | location_text.isNotNull()
    return F.when(F.coalesce(every, F.lit(False)), "explicit").when(some, "silver").otherwise("weak")


def training_records(voted: DataFrame, task: str) -> DataFrame:
    """Voted mentions as rows to train on, with the label columns of the task."""
    keys = ["sample_id", "note_id", "subject_id", "exam_name", "section", "mention_text", "full_text", "label_quality", "ws_confidence", "lf_coverage", "gate_level", "passed_gates"]
    label = F.col("ws_label")
    own = {
        "density": [label.alias("density_label")],
        "size": [(label == "true").alias("has_size"), F.lit(None).cast("double").alias("size_label"), F.lit(None).cast("string").alias("size_text")],
        "location": [label.alias("location_label"), (~label.isin("no_location", P.ABSTAIN)).alias("has_location")],
    }[task]
    return voted.select(*[c for c in keys if c in voted.columns], *own)


def text_window(full_text: Column, mention: Column, radius: int) -> Column:
    """The mention with so many characters around its first occurrence, whatever its case; the mention alone where it does not occur."""
    at = F.call_function("locate", F.lower(mention), F.lower(full_text))
    start = F.greatest(at - radius, F.lit(1))
    cut = F.substring(full_text, start, at + F.length(mention) + radius - start)
    return F.when((at > 0) & (F.length(mention) > 0), T.strip(cut)).otherwise(mention)


def gold_records(mentions: DataFrame, radius: int = 200) -> DataFrame:
    """Mentions as rows for reviewers: silver labels beside the text around the mention."""
    return mentions.select(
        "sample_id", "subject_id", "note_id", "mention_text", text_window(F.col("full_text"), F.col("mention_text"), radius).alias("text_window"), F.col("density_label").alias("silver_density_category"),
        F.col("has_size").alias("silver_has_size"), F.coalesce(F.col("size_label").cast("string"), F.lit("")).alias("silver_size_mm"), F.coalesce("location_label", F.lit("no_location")).alias("silver_location_lobe"), F.lit("test").alias("split"),
    )


def silver_records(bundles: DataFrame, recommendations: DataFrame, graph: dict) -> DataFrame:
    """Cases with their graph recommendation as reference labels, and which graph gave them."""
    r = recommendations.select("case_id", F.struct(*[c for c in recommendations.columns if c != "case_id"]).alias("recommendation_object"))
    j = bundles.join(r, "case_id")
    flat = [F.col(f"recommendation_object.{c}").alias(c) for c in recommendations.columns if c not in ("case_id", *bundles.columns)]
    names = {"cdsg_graph_version": "version", "cdsg_graph_id": "graph_id", "cdsg_rules_version": "rules_version"}
    return j.select(*bundles.columns, *flat, F.lit("cdsg_strong_silver").alias("label_source"), *[F.lit(graph.get(k)).cast("string").alias(n) for n, k in names.items()], "recommendation_object")


def label_key(abstention: Column, category: Column) -> Column:
    """What cases are stratified by: why they abstain, else their category."""
    return F.when(F.coalesce(abstention, F.lit("")) != "", F.concat(F.lit("abstain:"), abstention)).otherwise(F.concat(F.lit("category:"), F.coalesce(F.nullif(category, F.lit("")), F.lit("None"))))


def mismatch(flat: str, graph: str) -> Column:
    """Why two recommendations differ. flat, graph: structs of recommendation_level, recommendation_action, followup_interval, followup_modality, lung_rads_category, missing_information, and of graph also abstention_reason."""
    f, g = (lambda c: F.col(f"{flat}.{c}")), (lambda c: F.col(f"{graph}.{c}"))
    lacks = lambda side, what: F.coalesce(F.array_contains(side("missing_information"), what), F.lit(False))
    abstains, acts = F.coalesce(g("abstention_reason"), F.lit("")) != "", f("recommendation_level") != "insufficient_data"
    differ = F.lit(False)
    for c in ("recommendation_level", "recommendation_action", "followup_interval", "followup_modality"):
        differ = differ | ~f(c).eqNullSafe(g(c))
    gaps = F.size(F.array_except(f("missing_information"), g("missing_information"))) + F.size(F.array_except(g("missing_information"), f("missing_information")))
    return (
        F.when(abstains & acts & lacks(g, "density_category"), "case_bundle_density_missing_or_unclear__cdsg_abstains__flat_solid_fallback").when(abstains & acts & lacks(g, "nodule_size"), "case_bundle_size_missing__cdsg_abstains")
        .when(abstains & ~acts, "both_insufficient_but_abstention_metadata_differs").when(~f("lung_rads_category").eqNullSafe(g("lung_rads_category")) & lacks(f, "density_category") & ~lacks(g, "density_category"), "dominant_selection_delta_from_flat_density_fallback")
        .when(~f("lung_rads_category").eqNullSafe(g("lung_rads_category")), "category_delta_from_graph_or_modifier").when(differ, "terminal_template_delta").when(gaps > 0, "missing_info_policy_delta").otherwise("metadata_or_schema_delta")
    )


def coverage_table(recs: DataFrame, arrays: list[str]) -> DataFrame:
    """metric, n, denominator, rate over graph recommendations: actionable, abstaining, and how many have each array filled, of all and of the actionable; one pass."""
    acts = F.coalesce(F.col("abstention_reason"), F.lit("")) == ""
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    counts = {"total_cases": (F.count("*"), "n_all"), "actionable_count": (F.count_if(acts), "n_all"), "abstention_count": (F.count_if(~acts), "n_all")}
    for c in arrays:
        counts[f"{c}_nonempty_count"] = F.count_if(has(c)), "n_all"
        counts[f"actionable_{c}_nonempty_count"] = F.count_if(has(c) & acts), "n_act"
    one = recs.agg(F.count("*").alias("n_all"), F.count_if(acts).alias("n_act"), *[f.alias(k) for k, (f, _) in counts.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n"), F.col(d).alias("denominator")) for k, (_, d) in counts.items()])
    return one.select(F.inline(cells)).withColumn("rate", F.coalesce(F.try_divide(F.col("n").cast("double"), "denominator"), F.lit(0.0)))


def exam_groups(rows: DataFrame, exam: str, truth: str, predicted: str, labels: list[str], k: int = 5) -> DataFrame:
    """bucket, n, accuracy, macro_f1 of the k most frequent exams and of all others, largest first."""
    x = top_or_other(rows.withColumn(exam, F.trim(F.coalesce(exam, F.lit("")))), exam, k)
    t, p = F.col(truth), F.col(predicted)
    counts = [c for i, lab in enumerate(labels) for c in (F.count_if((t == lab) & (p == lab)).alias(f"b{i}"), F.count_if(t == lab).alias(f"t{i}"), F.count_if(p == lab).alias(f"p{i}"))]
    g = x.groupBy("bucket").agg(F.count("*").alias("n"), rate(t == p).alias("accuracy"), *counts)
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"b{i}"), F.col(f"t{i}") + F.col(f"p{i}")), F.lit(0.0)) for i in range(len(labels))]
    return g.select("bucket", "n", "accuracy", (sum(f1) / len(labels)).alias("macro_f1")).orderBy(F.desc("n"), "bucket")
