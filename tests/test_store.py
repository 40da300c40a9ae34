import json
from pathlib import Path

from pyspark.sql import functions as F

from notewright.sources import store, tables


def test_stored_is_made_again_when_its_input_changes(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(10).write.parquet(source)
    made = lambda k=2: spark.read.parquet(source).select((F.col("id") * k).alias("x"))
    files = lambda: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out").iterdir() if f.name.startswith("part")}
    assert store.stored(made(), path).agg(F.sum("x")).first()[0] == 90
    first = files()
    assert store.stored(made(), path).count() == 10 and files() == first  # the same plan of the same files
    assert store.stored(made(3), path).agg(F.sum("x")).first()[0] == 135 and files() != first
    spark.range(20).write.mode("overwrite").parquet(source)
    spark.catalog.refreshByPath(source)
    assert store.stored(made(3), path).count() == 20
    second = files()
    store.stored(made(3), path, salt="other code")
    assert files() != second
    (tmp_path / "out" / "_SUCCESS").unlink()  # a table that was not written whole
    third = files()
    store.stored(made(3), path, salt="other code")
    assert files() != third
    fourth = files()
    store.stored(made(3), path, salt="other code", force=True)
    assert files() != fourth


def test_fingerprints(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/a")
    read = lambda: spark.read.parquet(f"{tmp_path}/a").filter("id > 2").groupBy("id").count()
    assert store.fingerprint(read()) == store.fingerprint(read()) != store.fingerprint(read().filter("id > 3"))


def test_counts_while_writing(spark, tmp_path):
    """Counts are right after a task has failed and run again, and no row is read twice."""
    runs = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.range(100).select(F.concat(F.lit("s"), "id").alias("sample_id"), F.when(F.col("id") % 10 > 0, F.col("id") / 100).alias("probability"), F.lit("y").alias("label")).repartition(4).mapInArrow(pass_on, "sample_id string, probability double, label string")
    entry = tables.write_probabilities(df, f"{tmp_path}/p", split="val", source_path="v")
    assert entry == {"split": "val", "path": f"{tmp_path}/p", "source_path": "v", "truncated": False, "rows": 100, "missing": 10, "lowest": 0.01, "highest": 0.99}
    assert runs.value == 100 and spark.read.text(f"{tmp_path}/p").count() == 100


def test_manifest(spark, tmp_path):
    rows = {"train": [("a", "x"), ("b", "y"), ("c", None)], "test": [("d", "y")]}
    parts = {k: spark.createDataFrame(v, "id string, y string") for k, v in rows.items()}
    m = store.write_manifest(parts, str(tmp_path), label="y", seed=3)
    assert m == {"parts": {"train": {"rows": 3, "labelled": 2, "labels": ["x", "y"]}, "test": {"rows": 1, "labelled": 1, "labels": ["y"]}}, "rows": 4, "seed": 3}
    assert json.loads(next((tmp_path / "manifest").glob("part-*")).read_text()) == m


def test_written_to_the_shared_folder(spark):
    """What is written is read back, from spark.checkpoint.dir where that is set; a cluster without one is refused."""
    import pytest

    from notewright import session

    df = session.written(spark.range(5).select(F.col("id"), F.lit(None).cast("string").alias("s")), "some")
    at = df.inputFiles()[0]
    assert df.count() == 5 and df.columns == ["id", "s"] and "/some-" in at and Path(at.removeprefix("file://")).exists()
    assert session.release(spark) >= 1 and not Path(at.removeprefix("file://")).exists() and session.release(spark) == 0

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.workdir(Cluster)
    Cluster.sparkContext.getConf = staticmethod(lambda: {"spark.checkpoint.dir": "store://shared/"})
    assert session.workdir(Cluster) == "store://shared"
