import math

from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import IntegerType, StructField, StructType

from notewright.operators import audit, features, learning


def test_classifiers(spark):
    rows = [(f"a solid nodule number {i}", "solid") for i in range(30)] + [(f"ground glass opacity {i}", "ground_glass") for i in range(20)] + [(f"calcified spot {i}", "calcified") for i in range(10)]
    train = learning.balanced(spark.createDataFrame(rows, "t string, y string"), "y")
    assert {round(r.weight, 6) for r in train.collect()} == {round(60 / (3 * n), 6) for n in (30, 20, 10)}
    new = spark.createDataFrame([("one solid nodule", "solid"), ("ground glass", "ground_glass"), (None, None)], "t string, y string")
    for kind in ("logistic", "svm"):
        got = learning.predicted(learning.tfidf_classifier(train, "t", "y", kind=kind, vocabulary=200, iterations=5), new, "t").collect()
        assert [r.predicted_label for r in got[:2]] == ["solid", "ground_glass"] and len(got) == 3


def test_two_stage_and_hybrid(spark):
    df = spark.createDataFrame([("solid", 0.9, None), ("unclear", None, "rule"), (None, 0.2, None)], "l string, c double, r string")
    got = learning.two_stage(df, "l", "c").collect()
    assert [(r.stage1, r.stage2) for r in got] == [("explicit_density", "solid"), ("unclear_or_no_evidence", None), ("unclear_or_no_evidence", None)] and got[1].stage_weight == 1e-6
    assert [r[0] for r in df.select(learning.hybrid(df.r, df.l, df.c, 0.5, "none")).collect()] == ["solid", "rule", "none"]


def test_invalid_values(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", ""), (3, None, "z")], "k int, p string, q string")
    assert sorted(tuple(r) for r in audit.invalid_values(df, "k", {"p": ["a"], "q": ["x"]}).collect()) == [(2, "p", "b"), (3, "q", "z")]


def test_damped_counts(spark, tmp_path):
    """1 + ln of each count, in sparse, dense, empty and null vectors; the pipeline is the same after it was saved and loaded."""
    rows = [(0, Vectors.sparse(5, [1, 3], [2.0, 1.0])), (1, Vectors.dense([0.0, 3.0, 1.0])), (2, Vectors.sparse(4, [], [])), (3, None), (4, Vectors.sparse(3, [0], [7.0]))]
    df = spark.createDataFrame(rows, StructType([StructField("i", IntegerType()), StructField("v", VectorUDT())])).repartition(2)
    got = {r.i: r.w for r in features.DampedCounts(inputCol="v", outputCol="w").transform(df).collect()}
    assert got[3] is None and len(got) == 5
    for i, v in rows:
        if v is not None:
            assert got[i].size == v.size and [round(x, 12) for x in got[i].toArray()] == [round(1 + math.log(x), 12) if x else 0.0 for x in v.toArray()]
    train = spark.createDataFrame([("solid solid solid nodule", "s"), ("solid nodule", "s"), ("glass glass nodule", "g"), ("glass", "g")] * 5, "t string, y string")
    model = learning.tfidf_classifier(train, "t", "y", vocabulary=40, weight=None, iterations=20, damped=True)
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    probability = lambda m: [r.probability.toArray().tolist() for r in m.transform(train).orderBy("t").collect()]
    assert probability(model) == probability(again)
    # by hand: weights by rarity ln((n + 1) / (df + 1)), damped counts, normalised
    words = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    vector = next(r.features for r in model.transform(train).collect() if r.t == "solid solid solid nodule").toArray()
    idf = lambda df_: math.log(21 / (df_ + 1))
    want = {"solid": (1 + math.log(3)) * idf(10), "nodule": idf(15)}
    pairs = {"solid solid": (1 + math.log(2)) * idf(5), "solid nodule": idf(10)}
    size = math.sqrt(sum(x * x for x in [*want.values(), *pairs.values()]))
    assert all(abs(vector[words.index(w)] - x / size) < 1e-9 for w, x in want.items())


def test_sweep_is_single_fits_over_features_made_once(spark, tmp_path):
    """Six settings over two choices of features: rows are read for two, and scores are those of single fits."""
    rows = [(f"{'solid' if i % 3 else 'glass'} {'round' if i % 2 else 'solid'} nodule {i % 7}", "s" if i % 3 else "g") for i in range(90)]
    reads = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    plain = spark.createDataFrame(rows, "t string, y string")
    counted = plain.mapInArrow(pass_on, "t string, y string")
    grid = [{"vocabulary": v, "kind": k, "iterations": n} for v in (4, 40) for k, n in (("logistic", 3), ("logistic", 20), ("svm", 5))]
    got = learning.sweep(counted, plain, "t", "y", ["s", "g"], grid, folder=str(tmp_path), parallel=3).collect()
    six = reads.value
    want = [learning.experiment(plain, plain, "t", "y", ["s", "g"], **s).first() for s in grid]
    assert [(r.s_vocabulary, r.s_kind, round(r.accuracy, 9), round(r.macro_f1, 9)) for r in got] == [(str(s["vocabulary"]), s["kind"], round(w.accuracy, 9), round(w.macro_f1, 9)) for s, w in zip(grid, want, strict=True)]
    reads.add(-six)
    learning.sweep(counted, plain, "t", "y", ["s", "g"], grid[:1] + grid[3:4], folder=str(tmp_path))
    assert reads.value == six > 0
    assert len(list(tmp_path.glob("features-*"))) == 4
