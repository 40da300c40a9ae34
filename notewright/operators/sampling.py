"""Splits, samples and set checks that give the same rows on any cluster: order by hash, not by a generator's state."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

TRAIN, VAL = 0.70, 0.15
#: Leading hex digits by which groups are cut for ranks: 65,536 ranges.
DIGITS = 4


def draw(seed: int, *keys: Column) -> Column:
    """A hex text that orders rows at random, alike in every engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def ranked(rows: DataFrame, by: list[str], key: str, *, seed: int = 42, order: list[Column] | None = None, digits: int = DIGITS) -> DataFrame:
    """rows with s_rank, from 1 in each group of by in hash order of key, and s_n, the rows of the group.

    Ranks are counted in two steps, by leading hex digits and within them, so that no task holds a whole group, though a group may be all rows. The number of
    digits is the same at every size, so nothing is counted beforehand."""
    h = rows.withColumn("s_h", draw(seed, F.col(key)))
    h = h.withColumn("s_b", F.substring("s_h", 1, digits))
    size = h.groupBy(*by, "s_b").agg(F.count("*").alias("s_c"))
    w = Window.partitionBy(*by)
    before = size.select(*by, "s_b", F.coalesce(F.sum("s_c").over(w.orderBy("s_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s_before"), F.sum("s_c").over(w).alias("s_n"))
    before = before.select(*[F.col(c).alias(f"s_by_{c}") for c in by], F.col("s_b").alias("s_b2"), "s_before", "s_n")
    same = F.col("s_b") == F.col("s_b2")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"s_by_{c}"))
    inner = F.row_number().over(Window.partitionBy(*by, "s_b").orderBy("s_h", *(order or [F.col(key)])))
    out = h.join(before, same).withColumn("s_rank", F.col("s_before") + inner)
    return out.drop("s_h", "s_b", "s_b2", "s_before", *[f"s_by_{c}" for c in by])


def _part(n: Column, share: float) -> Column:
    """share of n as the decimal that it is written as: 0.7 of 90 is 63, not less."""
    return n * F.lit(Decimal(str(share)))


def subject_split(rows: DataFrame, key: str, *, seed: int = 42, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """key, split: distinct keys in random order, cut at the floors of their shares; with three or more no split is empty."""
    keys = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    r = ranked(keys, [], key, seed=seed)
    n, many = F.col("s_n"), F.col("s_n") >= 3
    at = F.greatest(F.floor(_part(n, train)), F.when(many, 1).otherwise(0))
    to = at + F.greatest(F.floor(_part(n, val)), F.when(many, 1).otherwise(0))
    to = F.when(many, F.least(to, n - 1)).otherwise(to)
    at = F.when(many, F.least(at, to - 1)).otherwise(at)
    split = F.when(F.col("s_rank") <= at, "train").when(F.col("s_rank") <= to, "val").otherwise("test")
    return r.select(key, split.alias("split"))


def label_split(groups: DataFrame, key: str, label: str, *, seed: int = 42, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """key, label, split by label: one group trains, two train and test, more are cut at rounded shares."""
    g = ranked(groups.select(key, label), [label], key, seed=seed)
    n, r = F.col("s_n"), F.col("s_rank")
    at = F.greatest(F.bround(_part(n, train)), F.lit(1))
    to = F.least(at + F.greatest(F.bround(_part(n, val)), F.lit(1)), n - 1)
    split = F.when(n == 1, "train").when(n == 2, F.when(r == 1, "train").otherwise("test")).when(r <= F.least(at, to - 1), "train").when(r <= to, "val").otherwise("test")
    return g.select(key, label, split.alias("split"))


def majority_label(rows: DataFrame, key: str, label: str, ordinal: str) -> DataFrame:
    """key and its most frequent label; ties go to the label seen first."""
    c = rows.groupBy(key, label).agg(F.count("*").alias("c"), F.min(ordinal).alias("first"))
    return c.groupBy(key).agg(F.max_by(label, F.struct("c", (-F.col("first")).alias("f"))).alias(label))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of a, of b, of both, of a alone, of b alone."""
    one = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return one.agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b")
    )


def leakage(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def strata_sample(rows: DataFrame, stratum: str, key: str, quotas: dict[str, int], *, seed: int = 42) -> DataFrame:
    """Up to a quota of rows of each stratum, in hash order; strata without a quota are left out."""
    want = F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum))
    return ranked(rows.filter(F.col(stratum).isin(*quotas)), [stratum], key, seed=seed).filter(F.col("s_rank") <= want).select(*rows.columns)


def proportional_sample(rows: DataFrame, stratum: str, key: str, size: int, *, seed: int = 42) -> DataFrame:
    """About size rows, each stratum by its share and at least one, then cut to size in order of rank and hash."""
    total = rows.count()
    want = F.greatest(F.lit(1), F.bround(F.lit(size) * F.col("s_n") / F.lit(max(total, 1))))
    r = ranked(rows, [stratum], key, seed=seed).filter(F.col("s_rank") <= want)
    return r.orderBy("s_rank", draw(seed, F.col(key)), key).limit(size).select(*rows.columns)


def oversampled(rows: DataFrame, score: str, key: str, size: int, *, factor: int = 3, seed: int = 42) -> DataFrame:
    """size rows at random among the factor * size best by score."""
    return rows.orderBy(F.desc(score), key).limit(factor * size).orderBy(draw(seed, F.col(key)), key).limit(size)


def greedy_strata(rows: DataFrame, key: str, strata: list[tuple[str, Column, list[Column]]], quota: int, size: int) -> DataFrame:
    """Rows chosen stratum by stratum, quota of each, best first, none twice; then filled to size in order of key.

    strata: name, predicate, order. What is chosen is at most quota rows a stratum and goes through the driver, so each
    stratum's plan reads rows once."""
    spark, schema = rows.sparkSession, rows.withColumn("stratum", F.lit("")).schema
    chosen: list = []
    left = lambda: rows.join(F.broadcast(spark.createDataFrame(chosen, schema).select(key)), key, "left_anti") if chosen else rows
    for name, test, order in strata:
        chosen += left().filter(test).orderBy(*order, key).limit(quota).withColumn("stratum", F.lit(name)).select(*schema.names).collect()
    chosen = chosen[:size]
    if len(chosen) < size:
        chosen += left().orderBy(key).limit(size - len(chosen)).withColumn("stratum", F.lit("fill")).select(*schema.names).collect()
    return spark.createDataFrame(chosen, schema)


def recommendation_eval(facts: DataFrame, size: int, *, key: str = "note_id", seed: int = 42) -> DataFrame:
    """Notes by what they can be evaluated on (a cue, a size, neither): a third of size each of the first two at most, the rest of the last."""
    has = lambda c: F.exists("nodules", lambda n: c(n))
    cue = has(lambda n: F.coalesce(n["recommendation_cue"] != "", F.lit(False)))
    sized = has(lambda n: n["size_mm"].isNotNull())
    kind = F.when(cue, "explicit_cue").when(sized, "rule_derived").otherwise("insufficient_data")
    # narrow rows are written: notes are read for facts once, whatever is asked of the rows afterwards
    rows = written(facts.select(key, "subject_id", kind.alias("eval_type"), cue.alias("has_recommendation_cue"), sized.alias("has_size")), "evaluated")
    n = {r.eval_type: r["count"] for r in rows.groupBy("eval_type").count().collect()}
    quota = {k: min(n.get(k, 0), size // 3) for k in ("explicit_cue", "rule_derived")}
    quota["insufficient_data"] = min(n.get("insufficient_data", 0), size - sum(quota.values()))
    return strata_sample(rows, "eval_type", key, quota, seed=seed)


#: What a set of case studies should show, in the order in which cases are looked for.
CASE_TAGS = ("solid", "ground_glass", "part_solid", "multiple_nodules", "size_missing", "smoking_unknown", "recommendation_cue_present", "recommendation_cue_absent", "high_confidence", "low_confidence", "change_present", "calcified")


def case_tags(facts: DataFrame, smoking: DataFrame | None = None) -> DataFrame:
    """note_id, subject_id, nodule_count, tags (sorted) of notes with nodules. smoking: subject_id, smoking_status_norm, one row a subject."""
    rows = facts.filter(F.col("nodule_count") > 0)
    if smoking is None:
        rows = rows.withColumn("s_unknown", F.lit(False))
    else:
        rows = rows.join(smoking.select("subject_id", (F.col("smoking_status_norm") == "unknown").alias("s_unknown")), "subject_id", "left")
    return rows.select("note_id", "subject_id", "nodule_count", note_tags(F.col("s_unknown")).alias("tags"))


def note_tags(smoking_unknown: Column) -> Column:
    """The tags (sorted) of a note with nodule_count and nodules."""
    any_ = lambda f: F.exists("nodules", f)
    is_ = lambda c, v: any_(lambda n: F.coalesce(n[c] == v, F.lit(False)))
    cue = lambda n: F.coalesce(n["recommendation_cue"] != "", F.lit(False))
    tests = {
        **{d: is_("density_category", d) for d in ("solid", "ground_glass", "part_solid", "calcified")},
        "multiple_nodules": F.col("nodule_count") > 1, "size_missing": any_(lambda n: n["size_mm"].isNull()), "smoking_unknown": F.coalesce(smoking_unknown, F.lit(False)),
        "recommendation_cue_present": any_(cue), "recommendation_cue_absent": any_(lambda n: ~cue(n)), "high_confidence": is_("confidence", "high"), "low_confidence": is_("confidence", "low"),
        "change_present": any_(lambda n: F.coalesce(n["change_status"] != "unclear", F.lit(False))),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])))


def cover_candidates(tagged: DataFrame, tags: tuple[str, ...], keep: int, *, key: str, order: str, seed: int) -> DataFrame:
    """tagged rows that a cover of at most keep rows may need, with c_mask (tags as bits), c_kind, c_at (their order) and c_rank.

    Rows fold into classes of equal tags; of a class the first keep by order (kind first), and of all rows the first keep in hash order
    (kind fill). Ranks are cut in each task before the shuffle, so that what is sent and what comes back is bounded by
    classes and keep, whatever the rows."""
    mask = sum((F.when(F.array_contains("tags", t), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tags)), F.lit(0))
    ways = F.array(
        F.struct(F.lit("first").alias("c_kind"), F.col("c_mask").alias("c_class"), F.col(order).cast("string").alias("c_at")),
        F.struct(F.lit("fill").alias("c_kind"), F.lit(-1).alias("c_class"), draw(seed, F.col(key)).alias("c_at")),
    )
    rows = tagged.withColumn("c_mask", mask).select("*", F.inline(ways))
    w = Window.partitionBy("c_kind", "c_class").orderBy("c_at", key)
    return rows.withColumn("c_rank", F.row_number().over(w)).filter(F.col("c_rank") <= keep).drop("c_class")


def case_studies(tagged: DataFrame, size: int = 16, *, order: str = "note_id", seed: int = 42) -> DataFrame:
    """The first unused note (by order, as text) that shows each tag, then others in hash order up to size; with the tag that a note was chosen for.

    One job; at most size + len(CASE_TAGS) notes for each of the classes of notes with equal tags come to the driver."""
    schema = tagged.withColumn("chosen_for", F.lit("")).schema
    spark, keep = tagged.sparkSession, size + len(CASE_TAGS)
    rows = cover_candidates(tagged, CASE_TAGS, keep, key="note_id", order=order, seed=seed).collect()
    by = {kind: sorted((r for r in rows if r["c_kind"] == kind), key=lambda r: (r["c_at"], r["note_id"])) for kind in ("first", "fill")}
    used, chosen = set(), []

    def choose(pool, reason: str, n: int) -> None:
        for r in pool:
            if n and r["note_id"] not in used:
                used.add(r["note_id"])
                chosen.append((*[r[c] for c in tagged.columns], reason))
                n -= 1

    for i, tag in enumerate(CASE_TAGS):
        choose((r for r in by["first"] if r["c_mask"] >> i & 1), tag, 1)
    choose(by["fill"], "fill", size - len(chosen))
    return spark.createDataFrame(chosen, schema)


def gold_strata(rows: DataFrame, key: str, strata: list[tuple[str, Column, int]], *, seed: int = 42) -> DataFrame:
    """rows with stratum: of each stratum in turn its number of rows in hash order, none twice, the last stratum filled up with any."""
    spark, schema = rows.sparkSession, rows.withColumn("stratum", F.lit("")).schema
    chosen: list = []
    for name, test, n in strata:
        pool = rows.join(F.broadcast(spark.createDataFrame(chosen, schema).select(key)), key, "left_anti") if chosen else rows
        got = pool.filter(test).orderBy(draw(seed, F.col(key)), key).limit(n).withColumn("stratum", F.lit(name)).select(*schema.names).collect()
        chosen += got
    short = sum(n for *_, n in strata) - len(chosen)
    if short > 0:
        pool = rows.join(F.broadcast(spark.createDataFrame(chosen, schema).select(key)), key, "left_anti") if chosen else rows
        chosen += pool.orderBy(draw(seed, F.col(key)), key).limit(short).withColumn("stratum", F.lit("fill")).select(*schema.names).collect()
    return spark.createDataFrame(chosen, schema)


def sampled(rows: DataFrame, key: str, size: int, *, seed: int = 42) -> DataFrame:
    """size rows in hash order, by key."""
    return rows.orderBy(draw(seed, F.col(key)), key).limit(size).orderBy(key)


def manifest_hash(seed: int, name: str, size: int) -> str:
    """Twelve hex digits that name a subset."""
    return hashlib.sha256(f"{seed}-{name}-{size}-phase4_v1".encode()).hexdigest()[:12]


def top_counts(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def top_or_other(rows: DataFrame, column: str, k: int) -> DataFrame:
    """rows with bucket: the value if it is among the k most frequent, else OTHER."""
    top = top_counts(rows.filter(F.col(column).isNotNull()), column, k).select(F.col(column).alias("bucket"))
    return rows.join(F.broadcast(top), F.col(column) == F.col("bucket"), "left").withColumn("bucket", F.coalesce("bucket", F.lit("OTHER")))
