"""Predictions of several tasks merged into candidate nodules of cases, with what did not fit and what conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms that speak for and against a lung nodule, and the words that outweigh the latter.
PULMONARY = ("lung", "lungs", "pulmonary", "nodule", "nodules", "granuloma", "lobe", "lobes", "lingula", "pleural", "ground-glass", "ground glass")
OTHER_ORGAN = (
    "adrenal", "hepatic", "liver", "renal", "kidney", "spleen", "splenic", "thyroid", "breast", "pancreas", "pancreatic", "lymph node", "lymph nodes",
    "mediastinal node", "hilar node", "paratracheal", "osseous", "bone", "rib lesion",
)
SURELY_PULMONARY = r"\b(lung|pulmonary|lobe|lingula|pleural|ground[- ]glass)\b"
#: What a candidate may have.
DENSITIES = ("solid", "part_solid", "ground_glass", "calcified", "fat_containing")
LOBES = ("RUL", "RML", "RLL", "LUL", "LLL", "lingula", "bilateral")
SEVERITY = {"fat_containing": 0, "calcified": 0, "ground_glass": 1, "solid": 2, "part_solid": 3}
DENSITY_ALIASES = {"partsolid": "part_solid", "groundglass": "ground_glass", "ggo": "ground_glass", "fat": "fat_containing"}


def last_per_key(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, ordinal).alias(value))


def merge_tasks(predictions: DataFrame, tasks: list[str], fields: tuple[str, ...] = ("label", "confidence")) -> DataFrame:
    """sample_id with its identity (of the first record seen) and each task's last record (its fields).

    predictions: sample_id, note_id, mention_text, task, label, confidence, ordinal. One shuffle; a full outer join of tasks by pivoting."""
    of = lambda t: F.max_by(F.when(F.col("task") == t, F.struct(*fields)), F.when(F.col("task") == t, F.col("ordinal"))).alias(t)
    return predictions.groupBy("sample_id").agg(F.min_by(F.struct("note_id", "mention_text"), "ordinal").alias("id"), *[of(t) for t in tasks]).select("sample_id", "id.*", *tasks)


def pulmonary(text: Column) -> Column:
    """(ok, reason)."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    among = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(norm, t))
    reason = F.when(norm == "", "empty_mention_text").when(among(OTHER_ORGAN) & ~norm.rlike(SURELY_PULMONARY), "non_pulmonary_mention_filtered").when(~among(PULMONARY), "no_pulmonary_nodule_cue")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def routed(merged: DataFrame, note_to_case: DataFrame) -> DataFrame:
    """merged with case_id and reason: why a row makes no candidate, null if it does. Accepted and rejected rows come from one pass."""
    j = merged.join(note_to_case, "note_id", "left").withColumn("p", pulmonary(F.col("mention_text")))
    facts = F.coalesce(*[F.col(t)["label"] for t in ("size", "density", "location")])
    reason = (
        F.when(F.col("note_id").isNull() | (F.col("note_id") == ""), "missing_note_id")
        .when(F.col("case_id").isNull(), "note_id_not_in_case_bundle")
        .when(F.col("sample_id").isNull(), "missing_sample_or_mention_id")
        .when(~F.col("p.ok"), F.col("p.reason"))
        .when(facts.isNull(), "no_direct_fact")
    )
    return j.withColumn("reason", reason).drop("p")


def density_name(value: Column) -> Column:
    """A density in the form that candidates have."""
    t = F.translate(F.lower(F.trim(value)), "- ", "__")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DENSITY_ALIASES.items() for x in kv]), t), t)


def mention_facts(merged: DataFrame) -> DataFrame:
    """merged (density_stage1, density_stage2, size, location: structs of label, confidence, size also size_mm) with the facts of each mention:
    the density where the first stage says that there is one, the size where there is one, the location where it is a lobe,
    each with its confidence, and of all the greatest."""
    known = lambda c, values: F.when(c.isin(*values), c)
    density = F.when(F.col("density_stage1.label") == "explicit_density", known(density_name(F.col("density_stage2.label")), DENSITIES))
    sized = F.col("size.label") == "has_size"
    out = merged.withColumn("density", density).withColumn("size_mm", F.when(sized, F.col("size.size_mm"))).withColumn("lobe", known(F.col("location.label"), LOBES))
    out = out.withColumn("has_size", F.when(F.col("size").isNotNull(), F.coalesce(sized, F.lit(False))))
    best = F.greatest(*[F.col(f"{t}.confidence") for t in ("density_stage1", "density_stage2", "size", "location")])
    sure = F.when(best.isNull(), "unknown").when(best >= 0.9, "high").when(best >= 0.7, "medium").otherwise("low")
    out = out.withColumn("confidence_value", best).withColumn("confidence", sure)
    return out.withColumn("missing_flags", F.flatten(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.array(*[F.lit(x) for x in names])) for c, names in (
        ("size_mm", ("size_mm", "size_text")), ("density", ("density_category", "density_text")), ("lobe", ("location_lobe", "location_text")))]))))


def note_aggregates(facts: DataFrame) -> DataFrame:
    """One candidate a note put together of several mentions; notes whose facts come from one mention have none.

    The largest size is chosen first; its mention is preferred for density and lobe, else the surest of each, then the
    greatest value. facts: case_id, note_id, sample_id, ordinal, mention_text, size_mm, density, lobe and size_confidence, density_confidence,
    lobe_confidence. One shuffle: the size's own density and lobe travel with it."""
    rank = lambda *cs: F.struct(*[F.coalesce(c, F.lit(d)).alias(f"r{i}") for i, (c, d) in enumerate(cs)], (-F.col("ordinal")).alias("o"))
    best = lambda f: F.max_by(F.struct(F.col(f).alias("v"), "sample_id", "mention_text", F.col(f"{f}_confidence").alias("c")), F.when(F.col(f).isNotNull(), rank((F.col(f"{f}_confidence"), 0.0), (F.col(f), ""))))
    size = F.struct(F.col("size_mm").alias("v"), "sample_id", "mention_text", F.col("size_confidence").alias("c"), *[F.col(x).alias(x) for x in ("density", "lobe", "density_confidence", "lobe_confidence")])
    g = facts.groupBy("case_id", "note_id").agg(
        F.max_by(size, F.when(F.col("size_mm").isNotNull(), rank((F.nullif("size_mm", F.lit(0.0)), -1.0), (F.col("size_confidence"), 0.0)))).alias("s"), best("density").alias("d0"), best("lobe").alias("l0")
    )

    def chosen(f: str, other: str) -> Column:
        own = F.struct(F.col(f"s.{f}").alias("v"), F.col("s.sample_id").alias("sample_id"), F.col("s.mention_text").alias("mention_text"), F.col(f"s.{f}_confidence").alias("c"))
        return F.when(F.col(f"s.{f}").isNotNull(), own).otherwise(F.when(F.col(f"{other}.v").isNotNull(), F.col(other)))

    g = g.withColumn("s", F.when(F.col("s.v").isNotNull(), F.col("s"))).withColumn("d", chosen("density", "d0")).withColumn("l", chosen("lobe", "l0"))
    sources = F.array_sort(F.array_distinct(F.array_compact(F.array("s.sample_id", "d.sample_id", "l.sample_id"))))
    texts = F.filter(F.array_compact(F.array("s.mention_text", "d.mention_text", "l.mention_text")), lambda x: x != "")
    return g.withColumn("sources", sources).filter(F.size("sources") > 1).select(
        "case_id", "note_id", F.concat("note_id", F.lit(":aggregate")).alias("sample_id"), F.col("s.v").alias("size_mm"), F.col("d.v").alias("density"), F.col("l.v").alias("lobe"),
        F.greatest("s.c", "d.c", "l.c").alias("confidence"), "sources", F.array_join(texts, " | ").alias("evidence_span"),
    )


def aggregate_risk(notes: Column, mentions: Column) -> Column:
    """Risk of a candidate put together of so many notes and mentions (arrays)."""
    return F.when(F.size(F.array_distinct(notes)) > 1, "high").when(F.size(F.array_distinct(mentions)) > 1, "medium").otherwise("low")


def ranked_candidates(rows: DataFrame) -> DataFrame:
    """Candidates of a note (case_id, note_id, sample_id, size_mm, density, confidence) with candidate_rank.

    With a density first, then by size, confidence, id, all descending; 0 counts as unknown."""
    w = Window.partitionBy("case_id", "note_id").orderBy(
        F.col("density").isNotNull().desc(), F.coalesce(F.nullif("size_mm", F.lit(0.0)), F.lit(-1.0)).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.desc("sample_id")
    )
    return rows.withColumn("candidate_rank", F.row_number().over(w))


def _usable(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fields unpivoted: case_id, note_id, mention, sample_id, confidence, place (order of mentions), field, v, number; without null, empty and unclear values.

    A mention is named by mention_id if there is one, else by sample_id; its order is ordinal, else sample_id."""
    have = set(rows.columns)
    mention = F.coalesce(F.nullif(F.col("mention_id"), F.lit("")), F.col("sample_id")) if "mention_id" in have else F.col("sample_id")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v"), F.col(f).try_cast("double").alias("number")) for f in fields])
    long = rows.select("case_id", "note_id", mention.alias("mention"), "sample_id", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.col("ordinal" if "ordinal" in have else "sample_id").alias("place"), F.inline(each))
    return long.filter(F.col("v").isNotNull() & ~F.col("v").isin("", "unclear"))


def selected_values(rows: DataFrame, fields: list[str], preferred: DataFrame | None = None) -> DataFrame:
    """case_id, note_id, field, value, mention, conflict, alternatives (sorted, piped), source_mentions (sorted, piped), mentions (how many), all.

    The preferred mention's value counts, if it has one (of several rows of that mention the surest); else the largest size (0 is none), and of other fields the
    surest value, the greatest text of equals. preferred: case_id, note_id, preferred, one row a note. rows: case_id, note_id, sample_id, confidence, the fields,
    and, if there, mention_id and ordinal. All fields are in one shuffle."""
    long = _usable(rows, fields)
    if preferred is not None:
        of = preferred.select(F.col("case_id").alias("p_case"), F.col("note_id").alias("p_note"), F.nullif(F.col("preferred"), F.lit("")).alias("preferred"))
        long = long.join(of, F.col("case_id").eqNullSafe(F.col("p_case")) & F.col("note_id").eqNullSafe(F.col("p_note")), "left").drop("p_case", "p_note")
    else:
        long = long.withColumn("preferred", F.lit(None).cast("string"))
    liked, size, sure = F.coalesce(F.col("mention") == F.col("preferred"), F.lit(False)), F.col("field") == "size_mm", F.col("confidence")
    large = F.coalesce(F.nullif(F.col("number"), F.lit(0.0)), F.lit(-1.0))
    ranked = long.withColumns({"r_a": liked, "r_b": F.when(~liked & size, large).otherwise(sure), "r_c": F.when(~liked & size, sure), "r_d": F.when(~liked & ~size, F.col("v"))})
    # of equals the first mention: the others' order is turned round by rank
    best = F.struct("r_a", "r_b", "r_c", "r_d")
    groups = ["case_id", "note_id", "field"]
    first = ranked.groupBy(*groups, "r_a", "r_b", "r_c", "r_d").agg(F.min_by(F.struct("v", "mention"), "place").alias("x"), F.collect_set("v").alias("vs"), F.collect_list("mention").alias("ms"), F.collect_set("sample_id").alias("ss"))
    g = first.groupBy(*groups).agg(F.max_by("x", best).alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("vs")))).alias("all"), F.array_sort(F.flatten(F.collect_list("ms"))).alias("ms"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ss")))).alias("samples"))
    return g.select(
        *groups, F.col("x.v").alias("value"), F.col("x.mention").alias("mention"), (F.size("all") > 1).alias("conflict"), F.array_join("all", "|").alias("alternatives"), F.array_join("ms", "|").alias("source_mentions"), F.size("ms").cast("long").alias("mentions"), "all", "samples",
    )


def conflicts(rows: DataFrame, fields: list[str], preferred: DataFrame | None = None) -> DataFrame:
    """Conflicting values of all fields of a note, the selected one (selected_values), their risk, what resolves them and whether to review."""
    g = selected_values(rows, fields, preferred).filter("conflict")
    r = conflict_risk(F.col("field"), F.size("all"), F.size("samples"))
    return g.select("case_id", "note_id", "field", F.col("value").alias("selected"), "alternatives", F.array_join("samples", "|").alias("source_mentions"), F.size("all").alias("n_alternatives"), r.alias("r")).select("*", "r.*").drop("r")


def conflict_risk(field: Column, alternatives: Column, mentions: Column) -> Column:
    """(risk, resolution, needs_review) of a conflict by field, number of values and of mentions."""
    cases = [
        ((field == "size_mm") & (alternatives <= 1), "low", "same_numeric_size_duplicate_mentions", False),
        ((field == "size_mm") & (alternatives <= 3), "medium", "largest_size_case_or_note_level_resolution_possible", False),
        (field == "size_mm", "medium", "many_size_values_largest_size_possible_but_review_recommended", True),
        ((field == "density_category") & (alternatives <= 1), "low", "same_density_duplicate_mentions", False),
        ((field == "density_category") & (mentions > 1), "high", "density_subtype_conflict_changes_cdsg_path_manual_review", True),
        (field == "density_category", "medium", "density_conflict_single_mention_duplicate", True),
        ((field == "location_lobe") & (alternatives <= 1), "low", "same_location_duplicate_mentions", False),
        ((field == "location_lobe") & (alternatives > 2), "medium", "multiple_location_mentions_likely_multiple_nodules", True),
        (field == "location_lobe", "medium", "location_conflict_low_cdsg_impact_but_grounding_risk", False),
    ]
    out = F
    for test, *values in cases:
        out = out.when(test, F.struct(*[F.lit(v).alias(k) for k, v in zip(("risk", "resolution", "needs_review"), values, strict=True)]))
    return out.otherwise(F.struct(F.lit("medium").alias("risk"), F.lit("unknown_conflict_type").alias("resolution"), F.lit(True).alias("needs_review")))


def nearest_density(rows: DataFrame) -> DataFrame:
    """case_id and the density nearest to the case's largest size: of the same note first, then by distance of mentions, then confidence.

    rows: case_id, note_id, ordinal, size_mm, density, confidence. The largest size is one row a case, so the join back is one to many."""
    size = rows.filter(F.col("size_mm").isNotNull()).groupBy("case_id").agg(F.max_by(F.struct("note_id", "ordinal", "size_mm"), F.struct("size_mm", -F.col("ordinal"))).alias("s"))
    near = rows.filter(F.col("density").isNotNull()).join(size, "case_id")
    rank = F.struct((F.col("note_id") == F.col("s.note_id")).cast("int").alias("a"), (-F.abs(F.col("ordinal") - F.col("s.ordinal"))).alias("b"), F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("ordinal")).alias("d"))
    return near.groupBy("case_id").agg(F.max_by(F.struct(F.col("s.size_mm").alias("size_mm"), "density"), rank).alias("x")).select("case_id", "x.*")


def simulate_strategies(rows: DataFrame) -> DataFrame:
    """strategy, case_id, size_mm, density under same mention, same note, same case, nearest: what each would put together."""
    # the surest density, the graver of equals
    grave = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("density")), F.lit(-1))
    best = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce("confidence", F.lit(0.0)), grave, -F.col("ordinal"))))
    mention = rows.filter("size_mm is not null and density is not null").groupBy("case_id").agg(F.max_by(F.struct("size_mm", "density"), F.struct("size_mm", -F.col("ordinal"))).alias("x")).select(F.lit("same_mention").alias("strategy"), "case_id", "x.*")
    note = rows.groupBy("case_id", "note_id").agg(F.max("size_mm").alias("size_mm"), best("density").alias("density")).filter("size_mm is not null and density is not null")
    note = note.groupBy("case_id").agg(F.max_by(F.struct("size_mm", "density"), F.struct("size_mm", "note_id")).alias("x")).select(F.lit("same_note").alias("strategy"), "case_id", "x.*")
    case = rows.groupBy("case_id").agg(F.max("size_mm").alias("size_mm"), best("density").alias("density")).filter("size_mm is not null and density is not null").select(F.lit("same_case").alias("strategy"), "case_id", "size_mm", "density")
    near = nearest_density(rows).select(F.lit("nearest").alias("strategy"), "case_id", "size_mm", "density")
    return mention.unionByName(note).unionByName(case).unionByName(near)
