"""Evaluation metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .running import RANGES, running


def rate(hit: Column, of: Column | None = None) -> Column:
    """Share of rows where hit holds among those where of does; 0 if there are none."""
    total = F.count("*") if of is None else F.count_if(of)
    hits = F.count_if(hit if of is None else hit & of)
    return F.coalesce(F.try_divide(hits.cast("double"), total), F.lit(0.0))


def distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, label, n, fraction of each column's values, in one pass: rows unpivoted, counted, divided by their dimension."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("label")) for c in columns])
    c = rows.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.label").agg(F.count("*").alias("n"))
    return c.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))


def confusion(rows: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """truth, predicted, n over the grid of labels, zeros too; other labels are left out."""
    pairs = [(a, b) for a in labels for b in labels]
    one = rows.agg(*[F.count_if((F.col(truth) == a) & (F.col(predicted) == b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("truth"), F.lit(b).alias("predicted"), F.col(f"c{i}").alias("n")) for i, (a, b) in enumerate(pairs)])))


def per_class(rows: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 for every label listed; one pass."""
    t, p = F.col(truth), F.col(predicted)
    counts = [c for i, x in enumerate(labels) for c in (F.count_if((t == x) & (p == x)).alias(f"tp{i}"), F.count_if((p == x) & ~F.coalesce(t == x, F.lit(False))).alias(f"fp{i}"), F.count_if((t == x) & ~F.coalesce(p == x, F.lit(False))).alias(f"fn{i}"))]
    one = rows.agg(*counts).select(F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, x in enumerate(labels)])))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.select("label", "tp", "fp", "fn", (tp + fn).alias("support"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def summary(rows: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """One row: accuracy, macro_f1 over all labels listed, weighted_f1; rows are read once."""
    t, p = F.col(truth), F.col(predicted)
    counts = [c for i, x in enumerate(labels) for c in (F.count_if((t == x) & (p == x)).alias(f"tp{i}"), F.count_if(p == x).alias(f"p{i}"), F.count_if(t == x).alias(f"t{i}"))]
    one = rows.agg(rate(t == p).alias("accuracy"), *counts)
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"tp{i}"), F.col(f"p{i}") + F.col(f"t{i}")), F.lit(0.0)) for i in range(len(labels))]
    support = sum(F.col(f"t{i}") for i in range(len(labels)))
    weighted = sum(f * F.col(f"t{i}") for i, f in enumerate(f1))
    return one.select("accuracy", (sum(f1) / len(labels)).alias("macro_f1"), F.coalesce(F.try_divide(weighted, support), F.lit(0.0)).alias("weighted_f1"))


def percentiles(rows: DataFrame, column: str, shares: dict[str, float], keys: list[str] = (), ranges: int = RANGES) -> DataFrame:
    """keys and, by name, the values at those shares of the rows, between two neighbours in proportion.

    Exact and in two steps: distinct values with their counts, ranked by ranges and within them. No task or
    aggregation state holds all values of a key."""
    keys = list(keys)
    # distinct values are written: what is above runs once, however often they are read
    d = written(rows.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("q_v")).agg(F.count("*").alias("q_c")), "values")
    r = running(d, "q_v", {"q_to": "q_c"}, keys=keys, ranges=ranges, totals={"q_n": "q_c"})
    r = r.withColumn("q_from", F.col("q_to") - F.col("q_c"))
    out = []
    for name, share in shares.items():
        at = (F.col("q_n") - 1) * F.lit(float(share))
        value = lambda p: F.max(F.when((F.col("q_from") <= p) & (p < F.col("q_to")), F.col("q_v")))
        low, high, part = value(F.floor(at)), value(F.ceil(at)), F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return r.groupBy(*keys).agg(*out)


def score_curve(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """score, p, n, tp, fp counted from the highest score down, and totals pos, neg: one row a distinct score, in ranges of about as many rows."""
    d = rows.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    return running(written(d, "scores"), "score", {"tp": "p", "fp": "n"}, descending=True, totals={"pos": "p", "neg": "n"})


def ranking(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: average precision (stepwise) and area under the ROC curve (ties count half); null with one class."""
    c = score_curve(rows, truth, score)
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("pos")
    auc = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / (F.max("pos") * F.max("neg"))
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    return c.agg(F.when(both, ap).alias("average_precision"), F.when(both, auc).alias("auroc"))


def best_threshold(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: the score from which predicting true has the best F1, the lowest among equals, and that F1; 0.5 with one class."""
    c = score_curve(rows, truth, score).withColumn("f1", 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos")))
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    return c.agg(F.when(both, F.max_by("score", F.struct("f1", -F.col("score")))).otherwise(0.5).alias("threshold"), F.when(both, F.max("f1")).alias("f1"))


def regression(rows: DataFrame, truth: str, predicted: str, tolerance: float = 1.0, *, missing: float | None = None) -> DataFrame:
    """One row: n, mae, exact and within-tolerance rates, median and largest error. Rows without a prediction are left out, or predict missing."""
    p = F.col(predicted) if missing is None else F.coalesce(predicted, F.lit(missing))
    e = rows.filter(F.col(truth).isNotNull() & p.isNotNull()).select(F.abs(F.col(truth) - p).alias("e"))
    one = e.agg(F.count("*").alias("n"), F.avg("e").alias("mae"), rate(F.col("e") == 0).alias("exact"), rate(F.col("e") <= tolerance).alias("within"), F.max("e").alias("max_error"))
    median = percentiles(e, "e", {"median_error": 0.5})
    return one.crossJoin(F.broadcast(median)).select("n", "mae", "exact", "within", "median_error", "max_error")


def temperature(rows: DataFrame, truth: str, logit: str, grid: list[float]) -> DataFrame:
    """temperature, nll for each of the grid; rows are read once."""
    z = lambda t: F.col(logit) / t
    nll = lambda t: F.avg(F.log1p(F.exp(-F.when(F.col(truth), z(t)).otherwise(-z(t)))))
    one = rows.agg(*[nll(t).alias(f"t{i}") for i, t in enumerate(grid)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)])))


def seed_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation by keys; of one value the deviation is 0."""
    std = F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value))
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), std.alias("std"))


def confidence_buckets(rows: DataFrame, truth: str, predicted: str, confidence: str) -> DataFrame:
    bucket = F.when(F.col(confidence) >= 0.95, "high").when(F.col(confidence) >= 0.80, "medium").otherwise("low")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), rate(F.col(truth) == F.col(predicted)).alias("accuracy"), F.avg(confidence).alias("mean_confidence"))


def three_way(rows: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """One row: rates of pairwise agreement, of all the same, of one that differs, of all different."""
    ab, ac, bc = F.col(a).eqNullSafe(F.col(b)), F.col(a).eqNullSafe(F.col(c)), F.col(b).eqNullSafe(F.col(c))
    return rows.agg(
        F.count("*").alias("n"), rate(ab).alias("agree_ab"), rate(ac).alias("agree_ac"), rate(bc).alias("agree_bc"),
        rate(ab & bc).alias("all_same"), rate((ab | ac | bc) & ~(ab & bc)).alias("one_differs"), rate(~(ab | ac | bc)).alias("all_different"),
    )


def missing_fields(rows: DataFrame, array: str = "missing_information") -> DataFrame:
    return rows.select(F.explode(array).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def numeric_summary(rows: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    c = F.col(column)
    one = rows.groupBy(*keys).agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 4).alias("mean"))
    of = percentiles(rows, column, {"median": 0.5, "p90": 0.9}, keys)
    if not keys:
        return one.crossJoin(F.broadcast(of))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return one.alias("a").join(of.alias("b"), on, "left").select("a.*", "b.median", "b.p90")


def label_stats(rows: DataFrame, split: str, quality: str) -> DataFrame:
    """split (null: all), quality, n, by grouping sets in one pass."""
    return rows.groupingSets([[split, quality], [quality]], split, quality).agg(F.count("*").alias("n"))

