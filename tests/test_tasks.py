import pytest
from pyspark.sql import functions as F

from notewright.operators import records, reports, sampling, tasks

ROWS = [
    ("s1", "n1", "c9", "five mm", "Part Solid", True, "RUL"), ("s2", "n1", None, None, "solid", False, "apex"), ("s3", "n2", "", "", None, None, None), ("s4", "n3", None, "t", "fat", True, "unclear"),
]
SCHEMA = "sample_id string, note_id string, case_id string, mention_text string, density_label string, has_size boolean, location_label string"


def test_label_vectors(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.sample_id: (r.input, r.label, r.y) for r in tasks.labelled(df, "location").collect()}
    assert got == {"s1": ("five mm", "RUL", 0), "s2": ("", "no_location", 8), "s3": ("", "no_location", 8), "s4": ("t", "unclear", 7)}
    assert [(r.label, r.y) for r in tasks.labelled(df, "size").orderBy("sample_id").collect()] == [("has_size", 1), ("no_size", 0), ("no_size", 0), ("has_size", 1)]
    assert [r.label for r in tasks.labelled(df, "density").orderBy("sample_id").collect()] == ["unclear", "solid", "unclear", "unclear"]
    for split in ("train", "val"):
        df.write.json(f"{tmp_path}/size_{split}.jsonl")
    with pytest.raises(Exception, match="size_test"):
        tasks.task_splits(spark, str(tmp_path), "size", SCHEMA)
    df.limit(1).write.json(f"{tmp_path}/size_test.jsonl")
    assert {r.split: r["count"] for r in tasks.task_splits(spark, str(tmp_path), "size", SCHEMA).groupBy("split").count().collect()} == {"train": 4, "val": 4, "test": 1}


def test_records_say_where_they_are_from(spark):
    df = tasks.with_case(spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([("n1", "k1"), ("n2", "k2")], "note_id string, case_id string"))
    p = spark.createDataFrame([("s1", None, 0.2), ("s1", None, 0.7), ("s2", None, 0.6)], "sample_id string, label string, probability double")
    got = {r.sample_id: r for r in tasks.exported(df, "size", "m", predictions=p, threshold=0.65).collect()}
    assert [(got[s].predicted_label, got[s].probability, got[s].prediction_source_type, got[s].model_export_required) for s in ("s1", "s2", "s3")] == [
        ("has_size", 0.7, "final_model_probability_file", False), ("no_size", 0.6, "final_model_probability_file", False), ("no_size", None, "constructed_fact_only_no_probability", True)
    ]
    assert [(got[s].case_id, got[s].mention_id, got[s].report_id) for s in ("s1", "s2", "s3", "s4")] == [("c9", "s1", "n1"), ("k1", "s2", "n1"), ("k2", "s3", "n2"), (None, "s4", "n3")]
    stage = {r.sample_id: (r.predicted_label, r.gold_or_constructed_label) for r in tasks.exported(df, "density_stage2", "m").collect()}
    assert stage == {"s1": ("part_solid", "part_solid"), "s2": ("solid", "solid"), "s3": (None, None), "s4": (None, "fat")}
    named = spark.createDataFrame([("s3", "explicit_density", 0.9)], "sample_id string, label string, probability double")
    one = {r.sample_id: (r.predicted_label, r.prediction_source_type) for r in tasks.exported(df, "density_stage1", "m", predictions=named).collect()}
    assert one["s3"] == ("explicit_density", "final_model") and one["s4"] == ("unclear_or_no_evidence", "constructed_fact_not_final_model")


def test_abstentions(spark):
    df = spark.createDataFrame([("x", ["a", "b"]), ("x", None), (None, ["a"]), ("None", ["b"]), ("y", ["a", ""])], "abstention_reason string, missing_information array<string>")
    got = {(r.dimension, r.label): (r["count"], round(r.fraction_of_abstentions, 4), r.fraction_of_total) for r in tasks.abstention_rows(df).collect()}
    assert got == {
        ("abstention_reason", "x"): (2, 0.6667, 0.4), ("abstention_reason", "y"): (1, 0.3333, 0.2), ("missing_information", "a"): (2, 0.6667, 0.4), ("missing_information", "b"): (1, 0.3333, 0.2), ("missing_information", "None"): (1, 0.3333, 0.2),
    }
    assert tasks.abstention_rows(df.limit(0)).count() == 0


def test_orders_samples_and_drift(spark):
    c = spark.createDataFrame([("k", "n", "f", "low", 9), ("j", "n", "f", "high", 2), ("i", "n", "f", "high", 5), ("h", "n", "f", "odd", 5), ("g", "n", "f", "medium", 5)], "case_id string, note_id string, field string, risk string, n_alternatives int")
    assert [r.case_id for r in reports.sorted_conflicts(c).collect()] == ["i", "j", "g", "k", "h"]
    ids = spark.range(50).select(F.col("id").cast("string").alias("k"))
    one = [r.k for r in sampling.sampled(ids, "k", 10).collect()]
    assert len(set(one)) == 10 and one == sorted(one) == [r.k for r in sampling.sampled(ids.repartition(3), "k", 10).collect()] and one != [r.k for r in sampling.sampled(ids, "k", 10, seed=1).collect()]
    b = spark.createDataFrame([("1", "x")], "case_id string, other string")
    r = spark.createDataFrame([("1", "level", None), ("2", "none", None)], "case_id string, recommendation_level string, abstention_reason string")
    s = records.silver_records(b, r, {"version": 3}).collect()
    assert len(s) == 1 and (s[0].other, s[0].recommendation_level, s[0].label_source, s[0].cdsg_graph_version, s[0].cdsg_graph_id) == ("x", "level", "cdsg_strong_silver", "3", None)
