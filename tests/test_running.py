import random

import pytest
from pyspark.sql import functions as F

from notewright.operators import metrics, running


def test_ranges_are_even_on_a_heavy_tail(spark):
    """A log-normal column: no range has three times the rows of the median one, and sums are those of a plain loop."""
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 3) for _ in range(20_000)] + [-5.0, float("inf"), float("-inf"), 0.0]
    df = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(values)], "v double, n int").repartition(4)
    cuts = running.limits(df, "v", 64)
    sizes = sorted(r["count"] for r in df.groupBy(running.range_of(F.col("v"), cuts)).count().collect())
    assert len(sizes) >= 60 and sizes[-1] < 3 * sizes[len(sizes) // 2]
    for descending in (False, True):
        got = {r.v: (r.s, r.all) for r in running.running(df, "v", {"s": "n"}, descending=descending, ranges=64, totals={"all": "n"}).collect()}
        total = 0
        for v, n in sorted(((v, 1 + i % 3) for i, v in enumerate(values)), reverse=descending):
            total += n
            assert got[v][0] == total
        assert {x[1] for x in got.values()} == {total}


def test_keys_and_nulls(spark):
    rows = [("a", 1.0, 1), ("a", None, 5), (None, 3.0, 7), (None, 2.0, 1), ("a", 2.0, 2), ("b", float("nan"), 1), ("b", 1e300, 2)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    got = {(r.k, str(r.v)): r.s for r in running.running(df, "v", {"s": "n"}, keys=["k"], ranges=4).collect()}
    assert got == {("a", "None"): 5, ("a", "1.0"): 6, ("a", "2.0"): 8, (None, "2.0"): 1, (None, "3.0"): 8, ("b", "1e+300"): 2, ("b", "nan"): 3}
    assert running.running(df.limit(0), "v", {"s": "n"}).count() == 0


def test_curve_of_scores_beyond_one(spark):
    """Scores of any scale, ties among them, against the plain definition."""
    rng = random.Random(2)
    rows = [(rng.random() < 0.3, round(rng.lognormvariate(0, 4), 1) * rng.choice([1, -1])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    got = {r.score: (r.tp, r.fp, r.pos, r.neg) for r in metrics.score_curve(df, "y", "s").collect()}
    pos = sum(y for y, _ in rows)
    for s in {s for _, s in rows}:
        assert got[s] == (sum(y and x >= s for y, x in rows), sum(not y and x >= s for y, x in rows), pos, len(rows) - pos)
    r = metrics.percentiles(df, "s", {"m": 0.5, "p": 0.9}).first()
    ordered = sorted(s for _, s in rows)
    at = lambda q: ordered[int(q * 2999)] + (ordered[min(int(q * 2999) + 1, 2999)] - ordered[int(q * 2999)]) * (q * 2999 - int(q * 2999))
    assert abs(r.m - at(0.5)) < 1e-9 and abs(r.p - at(0.9)) < 1e-6


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_positions(spark, tmp_path, form):
    """Two layouts of the same order are zipped row by row; small splits cut files into several tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        tables = {}
        for n in (3, 7):
            path = f"{tmp_path}/{form}{n}"
            spark.range(1000).select(F.col("id"), (F.col("id") * 2).alias("x")).repartitionByRange(n, "id").sortWithinPartitions("id").write.format(form).save(path)
            read = spark.read.format(form).schema("id long, x long").load(path)
            tables[n] = running.with_position(read, by_row=form == "parquet")
        both = running.zipped(tables[3].select("position", F.col("id").alias("a")), tables[7].select("position", F.col("x").alias("b")))
        rows = both.collect()
        assert len(rows) == 1000 and all(r.position == r.a and r.b == 2 * r.a for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    short = tables[3].filter("id < 10").select("position", F.col("id").alias("a"))
    other = tables[7].filter("id < 12").select("position", F.col("id").alias("b"))
    assert running.zipped(short, other).count() == 10 and running.zipped(short, other, longest=True).count() == 12
    with pytest.raises(ValueError, match="both tables"):
        running.zipped(short, short)
