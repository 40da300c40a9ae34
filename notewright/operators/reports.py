"""Tables of experiments and audits: wide tables over seeds, completeness, error cases, confidence and failure tables, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues, text as T
from ..session import written
from .audit import filled
from .metrics import percentiles, rate, seed_summary


# results over seeds


def wide_table(results: DataFrame, row: str, columns: list[str], value: str = "value", *, names: list[str] | None = None, percent: bool = True) -> DataFrame:
    """One line a row: for each combination of columns "mean +/- deviation" of value over its seeds, and their number.

    names: the combinations, joined by a blank, that the table has (without them those that occur)."""
    s = seed_summary(results, [row, *columns], value)
    scale = 100.0 if percent else 1.0
    shown = F.when(F.col("n") == 0, "--").otherwise(F.format_string("%.2f +/- %.2f", F.col("mean") * scale, F.coalesce("std", F.lit(0.0)) * scale))
    cells = s.select(row, F.concat_ws(" ", *columns).alias("cell"), shown.alias("shown"), "n")
    p = cells.groupBy(row)
    p = p.pivot("cell", names) if names else p.pivot("cell")
    return p.agg(F.first("shown").alias("value"), F.coalesce(F.first("n"), F.lit(0)).alias("n"))


def completeness(expected: DataFrame, results: DataFrame, keys: list[str], seeds: list[int]) -> DataFrame:
    """expected (keys and more) with present_seeds, missing_seeds, complete. Seeds are a short list; results are grouped before they are joined."""
    have = results.groupBy(*keys).agg(F.array_sort(F.collect_set("seed")).alias("h"))
    want = F.array(*[F.lit(s) for s in seeds])
    j = expected.join(have, keys, "left").withColumn("h", F.coalesce("h", F.array().cast("array<int>")))
    return j.select(*expected.columns, F.col("h").alias("present_seeds"), F.array_except(want, "h").alias("missing_seeds"), (F.size(F.array_except(want, "h")) == 0).alias("complete"))


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in rows.columns]


def best_by(results: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """The row of greatest value of each group, the least name among equals: best configuration, method, epoch."""
    rest = F.struct(*[c for c in results.columns if c not in keys])
    return results.groupBy(*keys).agg(F.max_by(F.struct(rest.alias("r")), F.struct(value)).alias("x"), F.max(value).alias("top")).select(*keys, "top").join(
        results.withColumnRenamed(value, "top"), [*keys, "top"]
    ).groupBy(*keys, F.col("top").alias(value)).agg(F.min(name).alias(name))


# errors


def by_position(rows: DataFrame, predictions: DataFrame, position: str) -> DataFrame:
    """Rows and predictions of the same position; the longer side is padded with nulls."""
    return rows.join(predictions, position, "full")


def error_cases(rows: DataFrame, gold: str, predicted: str, keep: list[str]) -> DataFrame:
    """keep, gold, predicted of the rows whose prediction differs, nulls compared as values."""
    return rows.filter(~F.col(gold).eqNullSafe(F.col(predicted))).select(*keep, F.col(gold).alias("gold"), F.col(predicted).alias("predicted"))


def size_error_cases(rows: DataFrame, gold: str, predicted: str, keep: list[str]) -> DataFrame:
    """The same of sizes, the largest error first; no prediction is 0, rows without a size are left out."""
    p = F.coalesce(predicted, F.lit(0.0))
    return rows.filter(F.col(gold).isNotNull() & (F.col(gold) != p)).select(*keep, F.col(gold).alias("gold"), p.alias("predicted"), F.abs(p - F.col(gold)).alias("absolute_error")).orderBy(F.desc("absolute_error"), *keep)


def least_certain(rows: DataFrame, confidence: str, key: str, k: int = 20) -> DataFrame:
    return rows.orderBy(confidence, key).limit(k)


def surest_errors(rows: DataFrame, gold: str, predicted: str, confidence: str, key: str, k: int = 20) -> DataFrame:
    return rows.filter(~F.col(gold).eqNullSafe(F.col(predicted))).orderBy(F.desc(confidence), key).limit(k)


def failure_modes(errors: DataFrame, ordinal: str, k: int = 5) -> DataFrame:
    """mode, n and the first example of the k most frequent kinds of error. errors: task, gold, predicted, sample_id, mention_text."""
    mode = F.concat(F.col("task"), F.lit(": gold="), F.coalesce(F.col("gold").cast("string"), F.lit("None")), F.lit(" pred="), F.coalesce(F.col("predicted").cast("string"), F.lit("None")))
    g = errors.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"), F.min_by(F.struct("sample_id", F.left("mention_text", F.lit(160)).alias("mention_text")), ordinal).alias("x"))
    return g.orderBy(F.desc("n"), "first").limit(k).select("mode", "n", "x.*")


def silver_gold(rows: DataFrame, silver: str, gold: str) -> DataFrame:
    """One row: total, disagreements and the agreement rate of two labels, nulls compared as values."""
    same = F.col(silver).eqNullSafe(F.col(gold))
    return rows.agg(F.count("*").alias("total"), F.count_if(~same).alias("disagreement_count"), rate(same).alias("agreement_rate"))


def disagreement_patterns(rows: DataFrame, silver: str, gold: str, k: int = 5) -> DataFrame:
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    bad = rows.filter(~F.col(silver).eqNullSafe(F.col(gold))).select(F.concat(F.lit("silver="), shown(silver), F.lit(" -> gold="), shown(gold)).alias("pattern"))
    return bad.groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(k)


#: Words that speak for a density, and patterns that speak for a size and a location.
SUPPORT = {
    "solid": ("solid", "soft tissue", "attenuation"),
    "part_solid": ("part-solid", "part solid", "subsolid", "sub-solid"),
    "ground_glass": ("ground-glass", "ground glass", "ggo", "crazy paving"),
    "calcified": ("calcified", "calcification", "granuloma"),
}
SIZE_SUPPORT = r"\b\d+(?:\.\d+)?\s*(?:mm|cm)\b"
LOCATION_SUPPORT = {
    "RUL": r"right upper lobe|\brul\b", "RML": r"right middle lobe|\brml\b", "RLL": r"right lower lobe|\brll\b", "LUL": r"left upper lobe|\blul\b", "LLL": r"left lower lobe|\blll\b",
    "lingula": r"\blingula\b|lingular", "bilateral": r"\bbilateral\b|both lungs|both lower lobes|both upper lobes",
}
LUNG_CUE = r"\b(lung|lungs|pulmonary|nodule|nodules|lobe|lobes|lingula|pleural|ground[- ]glass|ggo)\b"


def text_support(task: str, predicted: Column, text: Column) -> Column:
    """supported, not_supported or ambiguous: whether the text has words for the predicted label."""
    t = F.lower(F.coalesce(text, F.lit("")))
    if task == "size":
        return F.when(predicted != "has_size", "ambiguous").when(T.has(t, SIZE_SUPPORT), "supported").otherwise("not_supported")
    out = F.when(predicted.isin("no_location", "unclear"), "ambiguous")
    for label, words in (SUPPORT if task == "density" else LOCATION_SUPPORT).items():
        hit = T.has(t, words) if task == "location" else F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))
        out = out.when((predicted == label) & hit, "supported")
    return out.otherwise("not_supported")


def support_distribution(rows: DataFrame, task: str, predicted: str, text: str) -> DataFrame:
    return rows.groupBy(text_support(task, F.col(predicted), F.col(text)).alias("assessment")).agg(F.count("*").alias("n"))


# drift


def drift_profile(rows: DataFrame, key: str, positive: str, text: str) -> DataFrame:
    """One row for each value of key (a split): shares of positives, lengths, and how often each size feature occurs, among positives and others too."""
    f = cues.size_features(F.col(text))
    t = F.coalesce(text, F.lit(""))
    chars, words = F.char_length(t).cast("double"), F.regexp_count(t, F.lit(r"\S+")).cast("double")
    x = rows.select(key, F.col(positive).alias("p"), chars.alias("chars"), words.alias("tokens"), *[(f[k] == "yes").alias(k) for k, _ in cues.SIZE_FEATURES])
    # narrow rows are written: texts are read once, not once more for each percentile
    x = written(x, "profiled")
    keys = [k for k, _ in cues.SIZE_FEATURES]
    one = x.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if("p").alias("positive"), rate(F.col("p")).alias("positive_rate"), F.avg("chars").alias("chars_mean"), F.avg("tokens").alias("tokens_mean"),
        *[rate(F.col(k)).alias(f"{k}_rate") for k in keys], *[rate(F.col(k), F.col("p")).alias(f"{k}_positive") for k in keys], *[rate(F.col(k), ~F.col("p")).alias(f"{k}_negative") for k in keys],
    )
    for c in ("chars", "tokens"):
        one = one.join(percentiles(x, c, {f"{c}_p50": 0.5, f"{c}_p90": 0.9}, [key]), key)
    return one


def drift_distance(profiles: DataFrame, key: str, target: str) -> DataFrame:
    """key, distance of each profile to the target's: differences of rates, and of mean lengths in proportion. Profiles are a row a split."""
    names = ["positive_rate", "chars_mean", "tokens_mean", *[f"{k}_rate" for k, _ in cues.SIZE_FEATURES]]
    to = profiles.filter(F.col(key) == target).select(*[F.col(c).alias(f"t_{c}") for c in names])
    part = lambda c: F.abs(F.col(c) - F.col(f"t_{c}")) / (F.greatest(F.abs(F.col(f"t_{c}")), F.lit(1.0)) if c.endswith("mean") else F.lit(1.0))
    return profiles.crossJoin(F.broadcast(to)).select(key, sum(part(c) for c in names).alias("distance"))


# audits of predictions and reviews


def prediction_counts(mentions: DataFrame) -> DataFrame:
    """case_id and how many of its mentions have each prediction. mentions: case_id, sample_id, mention_text, stage1, stage2, stage2_applicable, size_mm, location."""
    c = F.col
    subtype = F.coalesce(c("stage2").isin("solid", "part_solid", "ground_glass", "calcified", "fat_containing"), F.lit(False))
    applies = F.coalesce(c("stage2_applicable"), F.lit(False))
    lobe = F.coalesce(c("location").isin("RUL", "RML", "RLL", "LUL", "LLL", "lingula", "bilateral"), F.lit(False))
    lung = T.has(F.coalesce("mention_text", F.lit("")), LUNG_CUE)
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, c("sample_id"))))
    return mentions.groupBy("case_id").agg(
        F.count("*").alias("prediction_mentions"), F.count_if(c("stage1") == "explicit_density").alias("stage1_explicit_density_mentions"), F.count_if(subtype).alias("stage2_subtype_mentions"),
        F.count_if(applies).alias("stage2_applicable_true_mentions"), F.count_if(subtype & ~applies).alias("stage2_subtype_but_not_applicable_mentions"), F.count_if(c("size_mm").isNotNull()).alias("size_mm_prediction_mentions"),
        F.count_if(lobe).alias("location_prediction_mentions"), F.count_if(lung).alias("pulmonary_cue_prediction_mentions"), ids(subtype).alias("stage2_subtype_ids"), ids(c("size_mm").isNotNull()).alias("size_mm_ids"),
    )


def density_root_cause(p: dict[str, Column], c: dict[str, Column], selected: Column) -> Column:
    """Why a case has no density, from its counts of predictions (p) and candidates (c) and the density that was selected."""
    return (
        F.when((p["stage1"] == 0) & (p["stage2"] > 0), "stage1_no_explicit_density_stage2_subtypes_not_applicable").when(p["stage1"] == 0, "no_explicit_density_prediction")
        .when(c["density"] == 0, "explicit_density_prediction_not_written_to_candidate").when((c["both"] == 0) & (c["size"] > 0), "size_and_density_split_across_candidates")
        .when(F.coalesce(selected, F.lit("")).isin("", "unclear"), "dominant_selection_or_graph_routing_selected_unclear_density").otherwise("other_density_abstention")
    )


def size_root_cause(p: dict[str, Column], c: dict[str, Column], selected: Column) -> Column:
    return (
        F.when(p["size"] == 0, "no_size_mm_prediction").when(c["size"] == 0, "size_mm_prediction_not_written_to_candidate").when((c["both"] == 0) & (c["density"] > 0), "size_and_density_split_across_candidates")
        .when(selected.isNull(), "dominant_selection_or_graph_routing_selected_missing_size").otherwise("other_size_abstention")
    )


def unwritten(predicted: Column, candidate: Column) -> Column:
    """Ids that were predicted and are in no candidate."""
    return F.array_sort(F.array_except(predicted, candidate))


def yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("yes", "y", "true", "1"), F.lit(False))


def uncertain(fields: list[str]) -> Column:
    """How many of the fields say uncertain."""
    return sum(F.coalesce(F.lower(F.trim(F.col(f).cast("string"))) == "uncertain", F.lit(False)).cast("int") for f in fields)


def _grouped(rows: DataFrame, groups: str) -> DataFrame:
    parts = cues.pipe_parts(F.col(groups))
    return rows.withColumn("audit_group", F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("ungrouped")))))


def group_summary(rows: DataFrame, groups: str, fields: list[str]) -> DataFrame:
    """audit_group and of its rows how many are of low confidence, need an expert, are uncertain somewhere, are grounded in evidence, as counts and rates.

    rows: confidence, expert, evidence_exists, evidence_supports, and the fields that may say uncertain. A row counts in each of its groups."""
    x = _grouped(rows, groups)
    low, expert, unsure = F.coalesce(F.col("confidence") == "low", F.lit(False)), yes(F.col("expert")), uncertain(fields) > 0
    ready = filled(F.col("evidence_exists")) & filled(F.col("evidence_supports"))
    ground = yes(F.col("evidence_exists")) & yes(F.col("evidence_supports"))
    return x.groupBy("audit_group").agg(
        F.count("*").alias("rows"), F.count_if(low).alias("low_confidence_count"), rate(low).alias("low_confidence_rate"), F.count_if(expert).alias("expert_count"), rate(expert).alias("expert_rate"),
        F.count_if(unsure).alias("uncertain_count"), rate(unsure).alias("uncertain_rate"), F.count_if(ground).alias("grounded_count"), F.count_if(ready).alias("ready_count"), rate(ground, ready).alias("grounded_rate"),
    )


def risk_flags(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, flag_reasons of the rows that have any reason to be looked at again.

    rows: expert, obvious_error, confidence, under_risk, over_risk, evidence_exists, evidence_supports and the fields that may say uncertain."""
    said = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    tests = {
        "needs_clinical_expert_review": yes(F.col("expert")), "obvious_codex_error": yes(F.col("obvious_error")), "low_codex_confidence": said("confidence") == "low",
        "medium_high_under_followup_risk_suggestion": said("under_risk").isin("medium", "high"), "medium_high_over_followup_risk_suggestion": said("over_risk").isin("medium", "high"),
        "codex_cited_evidence_not_found": filled(F.col("evidence_exists")) & ~yes(F.col("evidence_exists")), "codex_rationale_not_supported": filled(F.col("evidence_supports")) & ~yes(F.col("evidence_supports")),
        "high_codex_uncertainty": uncertain(fields) >= 3,
    }
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return rows.withColumn("r", reasons).filter(F.size("r") > 0).select(key, F.array_join("r", "|").alias("flag_reasons"))


def expand_decision(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row: counts over a reviewed pilot and whether they allow to go on: all annotated and reviewed, grounded in 80 %, few errors, few for experts, few unsure."""
    c = F.col
    ready = filled(c("evidence_exists")) & filled(c("evidence_supports"))
    ground = yes(c("evidence_exists")) & yes(c("evidence_supports"))
    one = rows.agg(
        F.count("*").alias("rows"), F.count_if(filled(c("confidence"))).alias("annotated"), F.count_if(filled(c("evidence_exists"))).alias("reviewed"), rate(ground, ready).alias("grounded_rate"),
        F.count_if(yes(c("obvious_error"))).alias("errors"), F.count_if(yes(c("expert"))).alias("experts"), F.count_if(F.lower(F.trim(c("confidence"))) == "low").alias("low"), F.count_if(uncertain(fields) > 0).alias("uncertain"),
    )
    few = F.greatest(F.lit(2), F.floor(c("rows") / 4))
    ok = (c("rows") > 0) & (c("annotated") == c("rows")) & (c("reviewed") == c("rows")) & (c("grounded_rate") >= 0.8) & (c("errors") <= 2) & (c("experts") <= few) & (c("low") <= few)
    return one.withColumn("expand", ok)


def confidence_table(rows: DataFrame, confidence: str) -> DataFrame:
    """confidence, n, rate of high, medium and low, in that order, zeros too."""
    labels = ("high", "medium", "low")
    one = rows.agg(F.count("*").alias("all"), *[F.count_if(F.col(confidence) == k).alias(k) for k in labels])
    cells = F.array(*[F.struct(F.lit(k).alias("confidence"), F.col(k).alias("n")) for k in labels])
    return one.select("all", F.inline(cells)).select("confidence", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), "all"), F.lit(0.0)).alias("rate"))


def uncertainty_driver(group: Column, missing: Column, conflict_fields: Column) -> Column:
    """What makes a case uncertain, the gravest first."""
    has = lambda c, w: F.coalesce(c.contains(w), F.lit(False))
    return (
        F.when(has(group, "high_risk_density_conflict"), "high-risk density conflict affecting possible Lung-RADS path").when(has(missing, "density_category"), "missing density prevents safe category assignment")
        .when(has(missing, "nodule_size"), "missing size prevents safe category assignment").when(has(missing, "nodule"), "no structured pulmonary nodule evidence")
        .when(F.coalesce(conflict_fields, F.lit("")) != "", F.concat(F.lit("candidate conflict fields: "), conflict_fields)).otherwise("clinical uncertainty noted by Codex-assisted self-check")
    )


#: How urgent a group of cases is.
PRIORITY = {"actionable_recommendation": 10, "high_risk_density_conflict": 20, "no_structured_nodule": 30, "missing_density_priority_sample": 40, "missing_size_priority_sample": 50}


def priority(groups: Column) -> Column:
    """The least priority of an array of groups."""
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.array_min(F.transform(groups, lambda g: F.coalesce(F.try_element_at(table, g), F.lit(99))))


def foremost(rows: DataFrame, scores: list[Column], key: str, k: int) -> DataFrame:
    """The k rows of greatest scores, compared in turn, then greatest key."""
    return rows.orderBy(*[s.desc() for s in scores], F.desc(key)).limit(k)


def sorted_conflicts(conflicts: DataFrame) -> DataFrame:
    """By risk, then most alternatives, then case."""
    risk = F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).when(F.col("risk") == "low", 2).otherwise(3)
    return conflicts.orderBy(risk, F.desc("n_alternatives"), "case_id", "note_id", "field")


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    """metric, value: conflicts in all, by field, risk and resolution, by grouping sets, and distinct cases and notes."""
    one = conflicts.agg(
        F.count("*").alias("total_conflict_rows"), F.count_distinct("case_id").alias("conflict_cases"), F.count_distinct("case_id", "note_id").alias("conflict_case_notes"),
        F.count_if("needs_review").alias("manual_review_rows"), F.count_if(~F.col("needs_review")).alias("aggregation_resolvable_rows"),
    )
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in one.columns])
    name = F.coalesce(F.concat(F.lit("field."), "field"), F.concat(F.lit("risk_level."), "risk"), F.concat(F.lit("resolution."), "resolution"))
    by = conflicts.groupingSets([["field"], ["risk"], ["resolution"]], "field", "risk", "resolution").agg(F.count("*").alias("value")).select(name.alias("metric"), "value")
    return one.select(F.inline(cells)).unionByName(by)


def conflict_evidence(conflicts: DataFrame, candidates: DataFrame, k: int = 3, chars: int = 160) -> DataFrame:
    """conflicts with evidence: up to k texts, in order, of their note's candidates that a conflicting mention made.

    conflicts: case_id, note_id, field, source_mentions (piped). candidates: case_id, note_id, ordinal, source_mention_ids, evidence_span."""
    c = candidates.select("case_id", "note_id", "ordinal", "source_mention_ids", F.left(F.replace(F.col("evidence_span"), F.lit("\n"), F.lit(" ")), F.lit(chars)).alias("e")).filter(F.coalesce(F.col("e") != "", F.lit(False)))
    own = F.struct("case_id", "note_id", "field")
    j = conflicts.withColumn("k_", own).join(c, ["case_id", "note_id"]).filter(F.arrays_overlap(F.split("source_mentions", r"\|"), "source_mention_ids"))
    # a note has few candidates; its first k are kept
    found = j.groupBy("k_").agg(F.slice(F.array_sort(F.collect_list(F.struct("ordinal", "e"))), 1, k)["e"].alias("es"))
    return conflicts.withColumn("k_", own).join(found, "k_", "left").withColumn("evidence", F.array_join(F.coalesce("es", F.array().cast("array<string>")), " || ")).drop("k_", "es")


def export_summary(predictions: DataFrame) -> DataFrame:
    """task, metric, value: exported rows in all, by source, by failure and by split; one pass, unpivoted."""
    cells = F.array_compact(F.array(
        F.lit("total"), F.concat(F.lit("source."), "prediction_source_type"), F.when(F.col("failure_reason").isNotNull(), F.concat(F.lit("failure."), "failure_reason")), F.concat(F.lit("split."), "source_split"),
    ))
    return predictions.select("task", F.explode(cells).alias("metric")).groupBy("task", "metric").agg(F.count("*").alias("value"))


def availability(lines: DataFrame, required: list[str]) -> DataFrame:
    """file, rows, parsed, and how many rows hold each required key. lines: file, value (a JSON text)."""
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    x = lines.filter(F.trim("value") != "").withColumn("k", keys)
    return x.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.get_json_object("value", "$").isNotNull()).alias("parsed"), *[F.count_if(F.array_contains("k", c)).alias(f"has_{c}") for c in required])


# case sets


def case_subset(abstention: Column, missing: Column) -> Column:
    """Which of four sets a case is in; null: none. missing: an array of what the flat rules lacked."""
    return (
        F.when((F.coalesce(abstention, F.lit("")) == "") & ~F.coalesce(F.array_contains(missing, "density_category"), F.lit(False)), "strict_hard_comparable")
        .when(abstention == "missing_nodule_density", "missing_density_abstention").when(abstention == "missing_nodule_size", "missing_size_abstention").when(abstention == "no_structured_nodule", "no_structured_nodule_abstention")
    )


def required_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns; a row without a partner is an error when it is read."""
    j = left.join(right.withColumn("r_there", F.lit(True)), key, "left")
    ok = F.when(F.col("r_there"), True).otherwise(F.raise_error(F.concat(F.lit(f"no partner for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return j.filter(ok).drop("r_there")


def enriched(cases: DataFrame, bundles: DataFrame, silver: DataFrame, audits: DataFrame, conflicts: DataFrame) -> DataFrame:
    """cases with bundle, silver and audit (the last of each by ordinal, as structs) and conflicts (an array)."""
    def last(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.coalesce(F.col("case_id").cast("string"), F.lit("")) != "").groupBy("case_id").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("case_id", "ordinal")]), "ordinal").alias(name))

    rows = F.struct(*[c for c in conflicts.columns if c != "case_id"])
    out = cases
    for df, name in ((bundles, "bundle"), (silver, "silver"), (audits, "audit")):
        out = out.join(last(df, name), "case_id", "left")
    return out.join(conflicts.groupBy("case_id").agg(F.array_sort(F.collect_list(rows)).alias("conflicts")), "case_id", "left")


def found_and_missing(gold: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """gold with found: whether rows have its key; one row a row of gold."""
    return gold.join(rows.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def pulmonary_gold(rows: DataFrame) -> DataFrame:
    """rows with included: lung targets that need no review."""
    said = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return rows.withColumn("included", (said("gold_is_pulmonary_target") == "yes") & (said("needs_review") == "0"))


def of_section(rows: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    return rows.filter(F.lower(F.coalesce("section", F.lit(""))).isin(*sections))


def explicit_training(rows: DataFrame, task: str) -> DataFrame:
    """Rows with an explicit label; of sizes also all without one, so that both classes remain."""
    keep = F.coalesce(F.col("label_quality") == "explicit", F.lit(False))
    return rows.filter(keep | ~F.coalesce(F.col("has_size"), F.lit(False)) if task == "size" else keep)


def highest_probability(rows: DataFrame, key: str, probability: str) -> DataFrame:
    """One row a key: that of the greatest probability."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), probability).alias("p")).select(key, "p.*")


def size_predictions(rows: DataFrame, probabilities: DataFrame, threshold: float) -> DataFrame:
    """rows (sample_id, has_size) with predicted_label and where it is from: the probability if there is one, else the label."""
    p = highest_probability(probabilities, "sample_id", "probability")
    j = rows.join(p, "sample_id", "left")
    label = F.when(F.col("probability").isNotNull(), F.col("probability") >= threshold).otherwise(F.coalesce("has_size", F.lit(False)))
    return j.withColumn("predicted_label", F.when(label, "has_size").otherwise("no_size")).withColumn("prediction_source_type", F.when(F.col("probability").isNotNull(), "model_probability").otherwise("constructed_fact_not_final_model"))


def two_stage_predictions(stage1: DataFrame, stage2: DataFrame, key: str = "sample_id") -> DataFrame:
    """stage1 (key, predicted_label) with the class of stage2 and whether it applies: only where stage1 says there is one."""
    two = stage2.select(key, F.col("predicted_label").alias("stage2_label"))
    j = stage1.join(two, key, "left")
    applies = F.coalesce(F.col("predicted_label") == "explicit_density", F.lit(False)) & F.col("stage2_label").isNotNull()
    failure = F.when(F.col("stage2_label").isNull(), "missing_stage2_prediction").when(~applies, "stage2_not_applicable")
    return j.withColumn("stage2_applicable", applies).withColumn("failure_reason", failure).withColumn("density", F.when(applies, F.col("stage2_label")))


def threshold_sweep(rows: DataFrame, rule: str, label: str, confidence: str, truth: str, thresholds: list[float], default: str) -> DataFrame:
    """threshold, accuracy, from_rule, from_model of taking the rule's label, else the model's if sure enough, else the default; rows are read once."""
    aggs = []
    for i, t in enumerate(thresholds):
        model = F.col(confidence) >= t
        p = F.coalesce(F.col(rule), F.when(model, F.col(label)), F.lit(default))
        aggs += [rate(p.eqNullSafe(F.col(truth))).alias(f"a{i}"), F.count_if(F.col(rule).isNull() & F.coalesce(model, F.lit(False))).alias(f"m{i}")]
    one = rows.agg(F.count_if(F.col(rule).isNotNull()).alias("r"), *aggs)
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"a{i}").alias("accuracy"), F.col("r").alias("from_rule"), F.col(f"m{i}").alias("from_model")) for i, t in enumerate(thresholds)])
    return one.select(F.inline(cells))


def location_protocol_accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy as it is, and under the protocol by which rows that truly have no location count as right. The latter is no accuracy."""
    right = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False))
    return rows.agg(rate(right).alias("accuracy"), rate(right | (F.col(truth) == "no_location")).alias("protocol_score"))


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small table as text; it is for reports and reads at most limit rows."""
    got = rows.limit(limit).collect()
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *[line(r) for r in got]])
