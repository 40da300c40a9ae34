import pytest
from pyspark.sql import functions as F

from notewright.operators import adapter, sampling, schema

ROW = "case_id int, note_id string, sample_id string, mention_id string, ordinal int, confidence double, size_mm double, density_category string"


def chosen(spark, rows, preferred=()):
    df = spark.createDataFrame([(1, "n", *r) for r in rows], ROW)
    like = spark.createDataFrame([(1, "n", p) for p in preferred], "case_id int, note_id string, preferred string")
    got = adapter.selected_values(df, ["size_mm", "density_category"], like if preferred else None).collect()
    return {r.field: (r.value, r.mention, r.conflict, r.alternatives, r.source_mentions) for r in got}


def test_selected_by_hand(spark):
    rows = [("s1", "m1", 1, 0.9, 4.0, "solid"), ("s2", None, 2, 0.5, 12.0, "part_solid"), ("s3", "", 3, 0.99, 0.0, "unclear"), ("s4", "m4", 4, 0.9, None, "")]
    got = chosen(spark, rows)
    assert got["size_mm"] == ("12.0", "s2", True, "0.0|12.0|4.0", "m1|s2|s3")
    assert got["density_category"] == ("solid", "m1", True, "part_solid|solid", "m1|s2")
    # the preferred mention comes first, if it has a value for the field
    assert chosen(spark, rows, ["m1"])["size_mm"][:2] == ("4.0", "m1")
    assert chosen(spark, rows, ["s2"])["density_category"][:2] == ("part_solid", "s2")
    assert chosen(spark, rows, ["s3"])["density_category"][:2] == ("solid", "m1")
    assert chosen(spark, rows, ["absent"]) == chosen(spark, rows, [""]) == got
    # ties: the surest of the largest sizes, the greatest text of equally sure others, the first mention of all that
    tied = [("b", None, 2, 0.5, 7.0, "solid"), ("a", None, 3, 0.5, 7.0, "part_solid"), ("c", None, 1, 0.2, 7.0, "solid")]
    assert chosen(spark, tied)["size_mm"][:3] == ("7.0", "b", False) and chosen(spark, tied)["density_category"][:2] == ("solid", "b")
    # two rows of the preferred mention: the surer
    twice = [("x", "m", 1, 0.1, 5.0, "solid"), ("y", "m", 2, 0.8, 3.0, "calcified"), ("z", "o", 3, 0.9, 30.0, "ground_glass")]
    assert chosen(spark, twice, ["m"])["size_mm"][0] == "3.0" and chosen(spark, twice, ["m"])["density_category"][0] == "calcified"
    assert chosen(spark, [("s", None, 1, None, None, "unclear")]) == {}


def test_conflicts_use_the_same_rule(spark):
    df = spark.createDataFrame([(1, "n", "s1", None, 1, 0.9, 4.0, "solid"), (1, "n", "s2", None, 2, 0.5, 12.0, "unclear"), (2, "n", "s3", None, 1, 0.5, 1.0, "solid"), (2, "n", "s4", None, 2, 0.6, 1.0, "calcified")], ROW)
    got = {(r.case_id, r.field): (r.selected, r.risk) for r in adapter.conflicts(df, ["size_mm", "density_category"]).collect()}
    assert got == {(1, "size_mm"): ("12.0", "medium"), (2, "density_category"): ("calcified", "high")}


def test_risk_of_aggregates(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["m"]), (2, ["a", "a"], ["m", "n"]), (3, ["a"], ["m", "m"])], "k int, notes array<string>, mentions array<string>")
    assert [r[1] for r in df.select("k", adapter.aggregate_risk(F.col("notes"), F.col("mentions"))).orderBy("k").collect()] == ["high", "medium", "low"]


def test_unknown_keywords_are_refused(spark):
    df = spark.createDataFrame([("abcdef", [1, 2, 3], 7), ("ab", [1], 10)], "a string, b array<int>, c int")
    rules = {"properties": {"a": {"maxLength": 2}, "b": {"maxItems": 1}, "c": {"exclusiveMaximum": 10, "multipleOf": 5}}, "title": "notes are let pass", "additionalProperties": True}
    errors = {r.a: r.errors for r in schema.validate_schema(df, rules).collect()}
    assert errors["abcdef"] == ["a: 'abcdef' is too long", "b: is too long", "c: 7 is not a multiple of 5"] and errors["ab"] == ["c: 10 is greater than or equal to the maximum of 10"]
    for bad, where in (({"properties": {"a": {"contains": 1}}}, "#/properties/a"), ({"allOf": [{"minProperties": 1}]}, "#/allOf/0"), ({"$defs": {"x": {"items": {"prefixItems": []}}}}, "#/$defs/x/items"), ({"additionalProperties": {"type": "string"}}, "can only be true or false")):
        with pytest.raises(ValueError, match=where.replace("$", r"\$")):
            schema.validate_schema(df, bad)


def test_cover_by_tags_is_the_greedy_one(spark):
    """Against a plain loop, for many orders of rows and few tags each."""
    import hashlib
    import random

    for seed in range(4):
        rng = random.Random(seed)
        rows = [(f"n{i:03}", i, 1, sorted(rng.sample(sampling.CASE_TAGS, rng.choice([0, 1, 2, 5])))) for i in rng.sample(range(900), rng.choice([5, 40, 300]))]
        df = spark.createDataFrame(rows, "note_id string, subject_id int, nodule_count int, tags array<string>").repartition(3)
        want, used = [], set()
        for tag in sampling.CASE_TAGS:
            some = sorted(r[0] for r in rows if tag in r[3] and r[0] not in used)
            if some:
                used.add(some[0])
                want.append((some[0], tag))
        draw = lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k)
        want += [(k, "fill") for k in sorted((r[0] for r in rows if r[0] not in used), key=draw)[: 16 - len(want)]]
        assert [(r.note_id, r.chosen_for) for r in sampling.case_studies(df, 16).collect()] == want
