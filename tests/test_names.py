import re

import pytest
from pyspark.sql import functions as F

from notewright.functions import names
from notewright.functions import text as T

TEXTS = [
    "There is a 5 mm solid nodule in the right upper lobe. It is stable.", "No nodule. 3 x 2 cm ground-glass opacity in the LLL, increased in size; follow-up CT in 6 months is suggested.", "Lung-RADS category: 4A. CT chest", None, "", "it's 'quoted' \\\\ text (a) = b",
    "Social History: Former smoker, 30 pack years, quit 5 years ago\nFamily History: none", "Smokes 2 ppd x 20 years", "yes", " 1.5 ", "Calcified granuloma in lingula. New 12 mm part-solid lesion. Measuring 4 mm.",
]


@pytest.fixture(scope="module")
def notes(spark):
    assert len(names.register(spark)) == len(names.SCALARS) + 1
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    df.createOrReplaceTempView("named_notes")
    return df


@pytest.mark.parametrize("name", sorted(names.SCALARS))
def test_functions_are_the_builders(spark, notes, name):
    got = spark.sql(f"SELECT i, {name}(text) AS v FROM named_notes ORDER BY i").collect()
    assert got == notes.select("i", names.SCALARS[name][1](F.col("text")).alias("v")).orderBy("i").collect()


def test_mentions_as_a_table(spark, notes):
    got = spark.sql("SELECT i, m.k, m.mention FROM named_notes, LATERAL nodule_mentions(text) m").collect()
    want = notes.select("i", F.posexplode(T.mentions(F.col("text"))).alias("k", "mention")).select("i", F.col("k") + 1, "mention").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) >= 4


def test_the_same_plan(spark, notes, tmp_path):
    """Called by name or built, the optimised plan is the same, and only the columns of use are read."""
    notes.write.parquet(f"{tmp_path}/n")
    df = spark.read.parquet(f"{tmp_path}/n")
    df.createOrReplaceTempView("stored_notes")
    plain = lambda d: re.sub(r"#\d+L?|x_\d+", "", d._jdf.queryExecution().optimizedPlan().toString())
    for name in ("size_mm", "lung_density", "followup_cue"):
        by_name = spark.sql(f"SELECT {name}(text) AS v FROM stored_notes WHERE text IS NOT NULL")
        built = df.filter("text IS NOT NULL").select(names.SCALARS[name][1](F.col("text")).alias("v"))
        assert plain(by_name) == plain(built)
    assert "ReadSchema: struct<text:string>" in by_name._jdf.queryExecution().executedPlan().toString()
