"""Weak supervision: labelling functions, weighted votes, quality gates and their statistics.

A labelling function is a column struct(lf_name, label, confidence, evidence_span); label null
abstains. The functions of a task make the array lf_details; votes are computed within the
row, so re-votes with other weights or sources reuse it without running the functions again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

LFS: dict[str, dict[str, Callable[[], Column]]] = {"density": {}, "size": {}, "location": {}}


def labelling_function(task: str, name: str, confidence: float):
    """Registers a builder of a struct (value, span[, sure]) for a task. The struct is computed once a row."""

    def keep(build):
        def column() -> Column:
            pair, sure = build(), F.lit(confidence)
            if isinstance(pair, tuple):
                pair, sure = pair

            def output(x: Column) -> Column:
                silent = x["value"].isNull()
                return F.struct(F.lit(name).alias("lf_name"), x["value"].cast("string").alias("label"), F.when(silent, F.lit(0.0)).otherwise(sure(x) if callable(sure) else sure).cast("double").alias("confidence"), F.when(~silent, x["span"]).alias("evidence_span"))

            return T.bound(pair, output)

        LFS.setdefault(task, {})[name] = column
        return build

    return keep


def _mention() -> Column:
    return F.coalesce(F.col("mention_text"), F.lit(""))


def _pair(value: Column, span: Column) -> Column:
    return F.struct(value.alias("value"), span.alias("span"))


def _found(span: Column, label: str) -> Column:
    """The label where there is a span."""
    return T.bound(span, lambda s: _pair(F.when(s.isNotNull(), label), s))


def _lone_solid(text: Column) -> Column:
    """The text with part-solid wordings taken out, so that solid is looked for in the rest."""
    return F.regexp_replace(text, T.ci(P.LF_PART_SOLID_SPAN), "\u0001")


def _dense(text: Column) -> Column:
    """A word for dense in the first sentence that speaks of calcification and has one."""
    hits = F.filter(T.sentences(text), lambda s: T.has(s, P.LF_CALCIFICATION) & T.has(s, P.LF_DENSE))
    return F.when(T.has(text, P.LF_CALCIFICATION) & T.has(text, P.LF_DENSE), T.found(F.try_element_at(hits, F.lit(1)), P.LF_DENSE))


def _where(text: Column, label: str, pattern: str) -> Column:
    return _lone_solid(text) if label == "solid" and pattern == P.SOLID else text


def _first_density(text: Column, rules) -> Column:
    """(value, span) of the gravest density that the rules, or dense calcification, find."""
    cases = [(label, T.has(_where(text, label, p), p), T.found(_where(text, label, p), p)) for label, p in rules] + [("calcified", _dense(text).isNotNull(), _dense(text))]
    rank = ("part_solid", "ground_glass", "calcified", "solid")
    return T.first_case([(hit, F.lit(label), span) for label, hit, span in sorted(cases, key=lambda x: rank.index(x[0]))])


@labelling_function("density", "LF-D1", 1.0)
def _d1():
    return _first_density(_mention(), P.LF_PRIMARY)


@labelling_function("density", "LF-D2", 0.75)
def _d2():
    return _first_density(_mention(), P.LF_FUZZY)


@labelling_function("density", "LF-D3", 0.85)
def _d3():
    spans = [T.found(_mention(), rf"\b{n.replace(' ', chr(92) + 's+')}\b(?:\W+\w+){{0,3}}\W+{P.LF_DENSITY_WORD}") for n in P.LF_NEGATORS]
    # each negated density has a density word, which most mentions lack
    return _found(F.coalesce(F.when(T.has(_mention(), P.LF_DENSITY_WORD), F.coalesce(*spans)), T.found(_mention(), P.LF_NONCALCIFIED)), "unclear")


@labelling_function("density", "LF-D4", 0.9)
def _d4():
    rules = [*P.LF_PRIMARY, *P.LF_FUZZY]
    tests = [(label, T.has(_where(_mention(), label, p), p)) for label, p in rules] + [("calcified", _dense(_mention()).isNotNull())]
    hits = [F.coalesce(F.regexp_extract_all(_where(_mention(), label, p), F.lit("(" + T.ci(p) + ")"), F.lit(1)), F.array().cast("array<string>")) for label, p in rules] + [F.array_compact(F.array(_dense(_mention())))]
    several = F.size(F.array_distinct(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])))) >= 2
    return T.first_case([(several, F.lit("unclear"), F.array_join(F.array_distinct(F.concat(*hits)), " | "))])


def impression_density(full_text: Column) -> Column:
    """(value, span) of the first sentence of a note's impression that speaks of a nodule and has a density."""
    body = F.regexp_extract(F.coalesce(full_text, F.lit("")), r"(?is)IMPRESSION\s*:\s*(.*)", 1)
    named = F.filter(T.sentences(body), lambda s: T.has(s, P.LF_MENTION))
    return F.try_element_at(F.filter(F.transform(named, lambda s: _first_density(s, P.LF_PRIMARY)), lambda x: x["value"].isNotNull()), F.lit(1))


@labelling_function("density", "LF-D5", 0.85)
def _d5():
    got = F.col("impression_density")
    return _pair(F.when(F.lower("section") == "findings", got["value"]), got["span"])


@labelling_function("size", "LF-S1", 1.0)
def _s1():
    return _found(T.size(_mention(), P.SIZES_STRICT)["span"], "true")


@labelling_function("size", "LF-S2", 0.9)
def _s2():
    return _found(F.coalesce(*[T.found(_mention(), p) for p in P.LF_SIZE_TYPOS]), "true")


@labelling_function("size", "LF-S3", 0.8)
def _s3():
    both = lambda s: T.has(s, P.LF_NUMBER) & T.has(s, P.LF_SIZE_CONTEXT)
    in_sentence = F.try_element_at(F.filter(T.sentences(_mention()), both), F.lit(1))
    # a sentence with both is in a mention with both
    return T.first_case([(both(_mention()), F.lit("true"), F.coalesce(in_sentence, T.nonempty(_mention())))])


@labelling_function("size", "LF-S4", 0.7)
def _s4():
    return _found(T.found(_mention(), P.LF_SIZE_WORDS), "true")


@labelling_function("size", "LF-S5", 0.9)
def _s5():
    none = ~T.has(_mention(), r"\d") & ~T.has(_mention(), P.LF_SIZE_WORDS) & ~T.has(_mention(), P.LF_SIZE_CONTEXT)
    return T.first_case([(none, F.lit("false"), T.nonempty(_mention()))])


@labelling_function("location", "LF-L1", 1.0)
def _l1():
    return T.first_of(_mention(), P.LF_LOCATIONS)


@labelling_function("location", "LF-L2", 0.85)
def _l2():
    one = lambda p, label, side: F.when(T.has(_mention(), p), F.struct(F.locate("\u0001", F.regexp_replace(_mention(), T.ci(p), "\u0001")).alias("at"), F.lit(label).alias("label"), F.lit(side).alias("side"), T.found(_mention(), p).alias("text")))
    lobes = F.array_sort(F.array_compact(F.array(*[one(*x) for x in P.LOBES])))

    def judged(found: Column) -> Column:
        two = F.size(F.array_distinct(F.transform(found, lambda x: x["side"]))) >= 2
        label = F.when(F.size(found) > 1, F.when(two, F.lit("bilateral")).otherwise(F.try_element_at(found, F.lit(1))["label"]))
        return F.struct(label.alias("value"), F.array_join(F.transform(found, lambda x: x["text"]), ", ").alias("span"), F.when(two, F.lit(0.85)).otherwise(F.lit(0.7)).alias("sure"))

    return T.bound(lobes, judged), lambda x: x["sure"]


@labelling_function("location", "LF-L3", 0.9)
def _l3():
    return _found(F.coalesce(*[T.found(_mention(), p) for p in P.LF_BILATERAL]), "bilateral")


@labelling_function("location", "LF-L4", 0.75)
def _l4():
    lobe = F.coalesce(*[T.found(_mention(), p) for p, _, _ in P.LOBES])
    span = F.coalesce(*[T.found(_mention(), p) for p in P.LF_SIDES])
    return T.first_case([(lobe.isNull() & span.isNotNull(), F.lit("unclear"), span)])


@labelling_function("location", "LF-L5", 0.7)
def _l5():
    full, own = F.coalesce(F.col("full_text"), F.lit("")), T.first_of(_mention(), P.LF_LOCATIONS)["value"]
    at = F.expr("locate(lower(coalesce(mention_text, '')), lower(coalesce(full_text, '')))")

    def near(at: Column) -> Column:
        around = F.concat(F.substring(full, F.greatest(at - 200, F.lit(1)), F.least(at - 1, F.lit(200))), F.substring(full, at + F.length(_mention()), F.lit(200)))
        return F.when(at > 0, T.bound(around, lambda t: T.first_of(t, P.LF_LOCATIONS)))

    got = T.bound(F.when(own.isNull() & (F.length(_mention()) > 0), at).otherwise(F.lit(0)), near)
    return _pair(got["value"], got["span"])


def label_rows(mentions: DataFrame, task: str) -> DataFrame:
    """mentions (mention_text, full_text, section, ...) with lf_details.

    impression_density is the same for all mentions of a note: numbered_mentions can bring it along."""
    if task == "density" and "impression_density" not in mentions.columns:
        mentions = mentions.withColumn("impression_density", impression_density(F.col("full_text")))
    return mentions.withColumn("lf_details", F.array(*[build() for build in LFS[task].values()]))


def vote(details: Column, weights: dict[str, float] | None = None, sources: list[str] | None = None) -> Column:
    """Struct label, confidence, lf_coverage, lf_agreement, supporting_lfs, all_votes, evidence_spans.

    Ties go to the label that was voted for first."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    active = F.filter(details, lambda x: x["label"].isNotNull() & (x["lf_name"].isin(sources) if sources else F.lit(True)))

    def weighed(active: Column) -> Column:
        score = lambda x: x["confidence"] * (F.coalesce(F.try_element_at(w, x["lf_name"]), F.lit(1.0)) if weights else F.lit(1.0))
        sum_of = lambda lab: F.aggregate(active, F.lit(0.0), lambda a, x: a + F.when(x["label"] == lab, score(x)).otherwise(F.lit(0.0)))
        votes = F.transform(F.array_distinct(F.transform(active, lambda x: x["label"])), lambda lab: F.struct(lab.alias("label"), sum_of(lab).alias("score")))
        return T.bound(votes, lambda v: T.bound(topped(v), lambda top: outcome(active, v, top)))

    def topped(votes: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("label"), F.lit(-1.0).alias("score"), F.lit(0.0).alias("total"))
        step = lambda a, v: F.struct(F.when(v["score"] > a["score"], v["label"]).otherwise(a["label"]).alias("label"), F.greatest(v["score"], a["score"]).alias("score"), (a["total"] + v["score"]).alias("total"))
        return F.aggregate(votes, start, step)

    def outcome(active: Column, votes: Column, top: Column) -> Column:
        return T.bound(F.filter(active, lambda x: x["label"] == top["label"]), lambda mine: F.struct(
            F.coalesce(top["label"], F.lit(P.ABSTAIN)).alias("label"),
            F.coalesce(F.try_divide(F.greatest(top["score"], F.lit(0.0)), top["total"]), F.lit(0.0)).alias("confidence"),
            F.size(active).alias("lf_coverage"),
            F.coalesce(F.try_divide(F.size(mine), F.size(active)), F.lit(0.0)).alias("lf_agreement"),
            F.transform(mine, lambda x: x["lf_name"]).alias("supporting_lfs"),
            votes.alias("all_votes"),
            F.filter(F.transform(mine, lambda x: x["evidence_span"]), lambda s: F.coalesce(s != "", F.lit(False))).alias("evidence_spans"),
        ))

    return T.bound(active, weighed)


def gates(label: Column, confidence: Column, coverage: Column, agreement: Column) -> Column:
    """Names of the gates passed, in order."""
    passed = F.array_compact(F.array(*[F.when((confidence >= c) & (coverage >= n) & (agreement >= a), F.lit(g)) for g, c, n, a in P.GATES]))
    return F.when(label == P.ABSTAIN, F.array().cast("array<string>")).otherwise(passed)


def aggregate_votes(rows: DataFrame, task: str, *, weights: dict[str, float] | None = None, uniform: bool = False, sources: list[str] | None = None) -> DataFrame:
    """rows with lf_details to ws_label, ws_confidence, ... and gates; gates see the confidence unrounded."""
    w = None if uniform else weights or P.LF_WEIGHTS[task]
    v = rows.withColumn("v", vote(F.col("lf_details"), w, sources)).withColumn("passed_gates", gates(F.col("v.label"), F.col("v.confidence"), F.col("v.lf_coverage"), F.col("v.lf_agreement")))
    return v.select(
        *rows.columns, F.col("v.label").alias("ws_label"), F.round("v.confidence", 4).alias("ws_confidence"), F.col("v.lf_coverage").alias("lf_coverage"), F.round("v.lf_agreement", 4).alias("lf_agreement"),
        F.col("v.supporting_lfs").alias("supporting_lfs"), F.col("v.all_votes").alias("all_votes"), F.col("v.evidence_spans").alias("evidence_spans"),
        F.coalesce(F.try_element_at("passed_gates", F.lit(-1)), F.lit("REJECTED")).alias("gate_level"), "passed_gates",
    )


def of_gate(rows: DataFrame, gate: str) -> DataFrame:
    return rows.filter(F.array_contains(F.coalesce("passed_gates", F.array().cast("array<string>")), gate))


def lf_coverage(rows: DataFrame) -> DataFrame:
    """lf_name, rows, fired, rate."""
    one = rows.select(F.explode("lf_details").alias("x"))
    return one.groupBy(F.col("x.lf_name").alias("lf_name")).agg(F.count("*").alias("rows"), F.count_if(F.col("x.label").isNotNull()).alias("fired")).withColumn("rate", F.col("fired") / F.col("rows"))


def lf_overlap(rows: DataFrame) -> DataFrame:
    """lf_a < lf_b: rows where both fired, and agreed. Pairs are made within the row; their number is that of functions squared."""
    active = F.filter("lf_details", lambda x: x["label"].isNotNull())
    pairs = F.flatten(F.transform(active, lambda a: F.transform(F.filter(active, lambda b: b["lf_name"] > a["lf_name"]), lambda b: F.struct(a["lf_name"].alias("a"), b["lf_name"].alias("b"), (a["label"] == b["label"]).alias("same")))))
    return rows.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("lf_a"), F.col("p.b").alias("lf_b")).agg(F.count("*").alias("overlap"), F.count_if("p.same").alias("agree"))


def conflict_count(rows: DataFrame) -> DataFrame:
    labels = F.array_distinct(F.array_compact(F.transform("lf_details", lambda x: x["label"])))
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.size(labels) > 1).alias("conflicts"))


def gate_retention(rows: DataFrame) -> DataFrame:
    """Every gate, also empty ones, with its rows and their share of all; one pass over rows."""
    counts = [F.count_if(F.array_contains("passed_gates", g)).alias(g) for g, *_ in P.GATES]
    one = rows.agg(F.count("*").alias("n"), *counts)
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("kept")) for g, *_ in P.GATES])).alias("x")).select("x.gate", "x.kept", F.coalesce(F.try_divide("x.kept", "n"), F.lit(0.0)).alias("retention"))
