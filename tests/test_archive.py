import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from notewright.sources import archive

ROWS = "".join(f"{i},{'F' if i % 2 else 'M'},{i % 90},name {i}\n" for i in range(5000))
TEXT = "subject_id,gender,anchor_age,label\n" + ROWS


@pytest.fixture
def zipped(tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("deep/down/data.csv", "wrong\n1\n")
        z.writestr("top/Data.csv", TEXT)
        z.writestr("deflated/more.csv", 'subject_id,note\n1,"two\nlines"\n2,\n', zipfile.ZIP_DEFLATED)
        z.writestr("hosp/patients.csv.gz", gzip.compress(("subject_id,gender,anchor_age,anchor_year,anchor_year_group,dod,extra\n" + "".join(f"{i},M,{i},2100,g,,x\n" for i in range(50))).encode()))
        z.writestr("hosp/admissions.csv.gz", gzip.compress(b"subject_id,hadm_id\n7,8\n"))
    return path


@pytest.mark.parametrize("size", [0, 1000, 4096, 1 << 30])
def test_ranges_of_a_stored_member(spark, zipped, size):
    """Every line is read once, whatever the ranges; columns come by name and type."""
    df = archive.read_member(spark, zipped, "data.csv", "anchor_age int, subject_id long, label string", range_bytes=size)
    assert df.rdd.getNumPartitions() == (1 if not size or size > len(TEXT) else -(-len(TEXT) // size))
    rows = df.collect()
    assert sorted(tuple(r) for r in rows) == sorted((i % 90, i, f"name {i}") for i in range(5000))


def test_ranges_that_end_at_lines(spark, tmp_path):
    """Limits just at, before and behind line ends; no line end at the end of the file."""
    lines = ["k,v"] + [f"{i},{'x' * (i % 4)}" for i in range(60)]
    path = str(tmp_path / "b.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("m.csv", "\n".join(lines))
    for size in range(1, 30, 3):
        rows = archive.read_member(spark, path, "m.csv", "k int, v string", range_bytes=size).collect()
        assert sorted((r.k, r.v) for r in rows) == [(i, "x" * (i % 4) or None) for i in range(60)], size


def test_deflated_and_gzipped(spark, zipped):
    assert [tuple(r) for r in archive.read_member(spark, zipped, "more.csv", "subject_id int, note string").collect()] == [(1, "two\nlines"), (2, None)]
    p = archive.patients(spark, zipped)
    assert p.count() == 50 and p.columns == ["subject_id", "gender", "anchor_age", "anchor_year", "anchor_year_group", "dod"] and p.filter("dod is null").count() == 50
    assert [tuple(r) for r in archive.admissions(spark, zipped).collect()] == [(7, "8")]
    with pytest.raises(Exception, match="not in the archive"):
        archive.read_member(spark, zipped, "absent.csv", "a string").collect()


def test_written_and_read_again(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select(F.col("id").alias("subject_id"), F.concat(F.lit('a "b", '), "id").alias("label"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("x")).repartition(4)
    archive.write_member(df, path, "patients.csv")
    archive.write_member(df, path, "patients.csv")
    again = archive.read_member(spark, path, "patients.csv", "subject_id long, label string, x double", range_bytes=2000)
    assert again.rdd.getNumPartitions() > 4 and sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert all(f.name.endswith(".zip") for f in (tmp_path / "out").iterdir())
