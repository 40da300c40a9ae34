"""Cue functions, adapter, schemas, reports, samples and sources by literal cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from notewright.functions import cues
from notewright.functions import text as T
from notewright.operators import adapter, graph, learning, metrics, quality, reports, sampling, schema, variants
from notewright.sources import tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("Right upper lobe opacity near the liver dome", (True, None)),
        ("calcified granuloma", (True, None)),
        ("hilar node", (False, "non_pulmonary_mention_filtered")),
        ("nodule next to a rib lesion", (False, "non_pulmonary_mention_filtered")),
        ("opacity in the RUL", (False, "no_pulmonary_nodule_cue")),
        ("Pleural  thickening\nby the thyroid", (True, None)),
        ("skin nodule", (True, None)),
        (" \t", (False, "empty_mention_text")),
        (None, (False, "empty_mention_text")),
    ],
)
def test_lung_mentions(spark, text, want):
    assert tuple(one(spark, adapter.pulmonary(F.col("t")), t=text)) == want


@pytest.mark.parametrize("text,want", [("a 4. mm nodule", 4.0), ("4  mm", 4.0), ("1.2 cm", 12.0), ("4 mm nodule", 4.0), ("tiny nodules ranging 1-2 mm", 1.5), ("mm", None), ("nodule measures 4 x 3 mm", 4.0)])
def test_sizes(spark, text, want):
    assert one(spark, T.size(F.col("t"))["value"], t=text) == want


def test_mention_facts_and_note_aggregates(spark):
    p = [
        ("s1", "n1", "c1", "lung nodule", "density_stage1", "explicit_density", 0.8, None, 1), ("s1", "n1", "c1", "lung nodule", "density_stage2", "GGO", 0.95, None, 2), ("s1", "n1", "c1", "lung nodule", "size", "has_size", 0.5, 7.0, 3),
        ("s2", "n1", "c1", "x", "density_stage1", "unclear_or_no_evidence", 0.9, None, 4), ("s2", "n1", "c1", "x", "density_stage2", "solid", 0.9, None, 5), ("s2", "n1", "c1", "x", "location", "RUL", 0.6, None, 6), ("s2", "n1", "c1", "x", "size", "no_size", 0.6, 3.0, 7),
    ]
    df = spark.createDataFrame(p, "sample_id string, note_id string, case_id string, mention_text string, task string, label string, confidence double, size_mm double, ordinal int")
    m = adapter.merge_tasks(df, ["density_stage1", "density_stage2", "size", "location"], ("label", "confidence", "size_mm"))
    got = {r.sample_id: r for r in adapter.mention_facts(m).collect()}
    assert (got["s1"].density, got["s1"].size_mm, got["s1"].lobe, got["s1"].confidence, got["s1"].has_size) == ("ground_glass", 7.0, None, "high", True)
    assert (got["s2"].density, got["s2"].size_mm, got["s2"].lobe, got["s2"].has_size) == (None, None, "RUL", False)
    assert got["s2"].missing_flags == ["size_mm", "size_text", "density_category", "density_text"]
    rows = [("c", "n", "a", 1, "A", 5.0, None, None, 0.5, None, None), ("c", "n", "b", 2, "B", 9.0, "solid", None, 0.2, 0.1, None), ("c", "n", "d", 3, "D", None, "calcified", "LLL", None, 0.9, 0.3), ("c", "m", "e", 4, "E", 3.0, "solid", "RUL", 0.1, 0.1, 0.1)]
    f = spark.createDataFrame(rows, "case_id string, note_id string, sample_id string, ordinal int, mention_text string, size_mm double, density string, lobe string, size_confidence double, density_confidence double, lobe_confidence double")
    g = adapter.note_aggregates(f).collect()
    assert len(g) == 1 and (g[0].size_mm, g[0].density, g[0].lobe, g[0].sources, g[0].evidence_span, g[0].confidence) == (9.0, "solid", "LLL", ["b", "d"], "B | B | D", 0.3)


def test_cues(spark):
    e = one(spark, cues.explicit_fields(F.col("t")), t="New 4 mm part-solid nodule, RUL. Follow-up suggested.")
    assert tuple(e) == (True, True, True, True, True, 5)
    assert one(spark, cues.key_terms(F.col("t")), t="Follow-up PET-CT in 3 months") == ["followup", "petct", "months"]
    assert one(spark, cues.key_terms(F.col("t")), t="see me at noon") == ["see", "noon"]
    assert one(spark, cues.agrees(F.col("a"), F.col("t")), a="Annual LDCT in 12 months", t="LDCT 12 months") is True
    assert one(spark, cues.agrees(F.col("a"), F.col("t")), a="none", t="") is False
    assert one(spark, cues.as_number(F.col("t")), t="4d") is None and one(spark, cues.as_number(F.col("t")), t=" 4.5 ") == 4.5
    assert one(spark, cues.slug(F.col("t")), t=" LF-D1 + d2!") == "lf_d1_d2"
    assert one(spark, cues.truncated(F.col("t"), 8), t="abc  def ghi") == "abc d..."
    assert one(spark, cues.nested(F.col("t"), "a.b"), t='{"a": {"b": 3}}') == "3" and one(spark, cues.nested(F.col("t"), "a.c.d"), t='{"a": {"b": 3}}') is None
    assert one(spark, cues.radiology_note_id(F.col("t"), F.lit(7), F.lit(None).cast("string")), t="12") == "7-RR-12"
    with pytest.raises(Exception, match="no number"):
        one(spark, cues.optional_number(F.col("t")), t="many")
    assert one(spark, cues.feature_block("size", F.col("t")), t="a 4 x 3 mm nodule").startswith("[SIZE CUE FEATURES] size_2d_pattern=yes ; size_3d_pattern=no ; ")
    assert one(spark, cues.augmented("location", F.col("t"), F.lit("")), t="RUL").endswith("\nRUL")


def test_schema_keywords(spark):
    s = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"oneOf": [{"type": "string", "pattern": "^x"}, {"type": "string", "minLength": 3}]}, "c": {"type": "array", "items": {"$ref": "other.json#/$defs/kind"}, "uniqueItems": True}, "d": {"type": "object", "required": ["e"], "properties": {"e": {"const": 1}}}},
        "if": {"properties": {"a": {"const": 2}}}, "then": {"properties": {"b": {"type": "null"}}},
    }
    store = {"other.json": {"$defs": {"kind": {"enum": ["u", "v"]}}}}
    rows = [(1, "x", ["u", "v"], (1,), None), (0, "ab", ["u", "u"], (2,), None), (None, "xyz", ["w"], None, None), (2, "x", None, None, "more")]
    df = spark.createDataFrame(rows, "a int, b string, c array<string>, d struct<e: int>, extra string")
    got = [r.errors for r in schema.validate_schema(df, s, store).collect()]
    assert got[0] == []
    assert got[1] == ["a: 0 is less than the minimum of 1", "b: is not valid under exactly one of the given schemas", "c: has non-unique elements", "d.e: 1 was expected"]
    assert got[2] == ["(root): 'a' is a required property", "b: is not valid under exactly one of the given schemas", "c.0: 'w' is not one of ['u', 'v']"]
    assert got[3] == ["(root): Additional properties are not allowed ('extra' was unexpected)", "b: is not of type 'null'"]


def test_schema_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"$id": "http://x/a.json", "type": "object", "properties": {"k": {"type": "string"}}}))
    store = schema.load_schemas(spark, str(tmp_path))
    assert set(store) == {"a.json", "http://x/a.json"}
    assert schema.validate_schema(spark.createDataFrame([(1,)], "k int"), store["a.json"], store).first().errors == ["k: 1 is not of type 'string'"]


def test_condition_texts(spark, tmp_path):
    c = {"op": "all", "conditions": [{"op": "range", "fact": "size_mm", "gte": 6, "lt": 8}, {"op": "missing", "fact": "d"}, {"op": "in", "fact": "d", "values": ["a"]}]}
    assert graph.condition_text(c) == "all(6 <= size_mm < 8; d missing; d in ['a'])"
    assert graph.condition_text({"op": "odd"}) == '{"op": "odd"}'
    (tmp_path / "g.json").write_text(json.dumps(graph.lung_graph()))
    assert graph.load_graph(spark, str(tmp_path / "g.json")) == graph.lung_graph()


def test_evaluation_of_nothing(spark):
    f = spark.createDataFrame([], "note_id string, nodule_count int, nodules array<struct<size_mm: double, density_category: string, location_lobe: string, change_status: string, recommendation_cue: string>>")
    r = quality.radiology_evaluation(f).first()
    assert r.total_notes == 0 and r.note_level_success_rate == 0 and r.size_mm_extract_rate == 0 and r.avg_nodules_per_note == 0
    f = spark.createDataFrame([("a", -1, [(None, "unclear", "RUL", None, "x")]), ("b", None, None)], f.schema)
    r = quality.radiology_evaluation(f).first()
    assert (r.total_nodules, r.nodule_detect_rate, r.density_category_extract_rate, r.location_lobe_extract_rate, r.recommendation_cue_extract_rate) == (1, 0.5, 0.0, 1.0, 1.0)
    labels = spark.createDataFrame([("a", None, "unclear"), ("gone", 3.0, None)], "note_id string, size_mm double, density_category string")
    x = quality.explicit_agreement(f, labels).first()
    assert (x.labelled, x.explicit_size_mm_rate, x.explicit_density_category_rate) == (2, 0.5, 1.0)


def test_cue_recommendation(spark):
    df = spark.createDataFrame([("c", [([("",), ("PET scan in 1 Month",)],)]), ("d", [([(None,)],)])], "case_id string, radiology_facts array<struct<nodules: array<struct<recommendation_cue: string>>>>")
    got = {r.case_id: r for r in variants.cue_recommendations(df).collect()}
    assert (got["c"].followup_interval, got["c"].followup_modality, got["c"].recommendation_level) == ("1 month", "PET-CT", "actionable")
    assert got["d"].recommendation_level == "insufficient_data" and got["d"].missing_information == ["recommendation_cue"]
    assert sorted(variants.tagged({"a": df.select("case_id"), "b": df}).select("variant").distinct().toPandas()["variant"]) == ["a", "b"]


def test_reports(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i int, gold string")
    pred = spark.createDataFrame([(0, "a"), (1, "c")], "i int, p string")
    z = reports.by_position(rows, pred, "i")
    assert sorted(tuple(r) for r in reports.error_cases(z, "gold", "p", ["i"]).collect()) == [(1, "b", "c"), (2, "c", None)]
    with pytest.raises(Exception, match="no partner"):
        reports.required_join(rows, pred, "i").collect()
    assert one(spark, reports.priority(F.split("t", r"\|")), t="no_structured_nodule|high_risk_density_conflict|else") == 20
    assert one(spark, reports.uncertainty_driver(F.col("g"), F.col("m"), F.lit(None).cast("string")), g="x", m="nodule_size|z") == "missing size prevents safe category assignment"
    assert reports.missing_columns(rows, ["i", "k"]) == ["k"]
    assert reports.markdown(pred.orderBy("i")) == "| i | p |\n| --- | --- |\n| 0 | a |\n| 1 | c |"
    one_ = spark.createDataFrame([("s", "explicit_density"), ("t", "explicit_density"), ("u", "none")], "sample_id string, predicted_label string")
    two = spark.createDataFrame([("s", "solid"), ("u", "solid")], "sample_id string, predicted_label string")
    assert sorted((r.sample_id, r.density, r.failure_reason) for r in reports.two_stage_predictions(one_, two).collect()) == [("s", "solid", None), ("t", None, "missing_stage2_prediction"), ("u", None, "stage2_not_applicable")]
    lines = spark.createDataFrame([("f", '{"a": 1, "b": 2}'), ("f", "bad"), ("f", " "), ("g", '{"b": 1}')], "file string, value string")
    assert sorted(tuple(r) for r in reports.availability(lines, ["a"]).collect()) == [("f", 2, 1, 1), ("g", 1, 1, 0)]
    cases = spark.createDataFrame([("c",), ("d",)], "case_id string")
    info = spark.createDataFrame([("c", 1, "old"), ("c", 2, "new"), ("", 3, "x")], "case_id string, ordinal int, v string")
    e = {r.case_id: r for r in reports.enriched(cases, info, info, info, info.select("case_id", "v")).collect()}
    assert e["c"].bundle.v == "new" and [x.v for x in e["c"].conflicts] == ["new", "old"] and e["d"].bundle is None
    w = spark.createDataFrame([("A", "findings", "explicit", True), ("B", "Impression", "weak", False)], "k string, section string, label_quality string, has_size boolean")
    assert [r.k for r in reports.of_section(w, ("impression",)).collect()] == ["B"]
    assert reports.explicit_training(w, "size").count() == 2 and reports.explicit_training(w, "density").count() == 1
    counts = {k: F.lit(v) for k, v in (("stage1", 1), ("stage2", 0), ("size", 0))}
    cand = {k: F.lit(v) for k, v in (("density", 2), ("both", 0), ("size", 1))}
    assert one(spark, reports.density_root_cause(counts, cand, F.col("t")), t=None) == "size_and_density_split_across_candidates"
    assert one(spark, reports.size_root_cause(counts, cand, F.lit(None)), t=None) == "no_size_mm_prediction"
    assert one(spark, reports.unwritten(F.split("t", ","), F.split("u", ",")), t="b,a,c", u="c") == ["a", "b"]


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", None), (None, 1.0), (None, 2.0)], "k string, v double")
    got = {r.k: (r.m, r.q) for r in metrics.percentiles(df, "v", {"m": 0.5, "q": 0.9}, ["k"]).collect()}
    assert got["a"] == (3.0, pytest.approx(61.6)) and got["b"] == (5.0, 5.0) and got[None] == (1.5, pytest.approx(1.9))
    assert metrics.percentiles(df, "v", {"m": 0.5}, ranges=3).first().m == 2.5


def test_ranks_in_two_steps(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    one_, two = (sampling.ranked(df, ["g"], "k", digits=d).orderBy("k").collect() for d in (1, 3))
    assert one_ == two and sorted(r.s_rank for r in one_ if r.g == 1) == list(range(1, 1001)) and {r.s_n for r in one_} == {1000}
    assert sampling.strata_sample(df, "g", "k", {0: 5, 1: 2}).groupBy("g").count().orderBy("g").collect()[0]["count"] == 5


def test_case_studies(spark):
    tags = [("n1", ["solid", "calcified"]), ("n2", ["solid"]), ("n3", ["calcified"]), ("n4", []), ("n5", [])]
    df = spark.createDataFrame([(k, 1, 1, t) for k, t in tags], "note_id string, subject_id int, nodule_count int, tags array<string>")
    got = {r.note_id: r.chosen_for for r in sampling.case_studies(df, 4).collect()}
    assert got["n1"] == "solid" and got["n3"] == "calcified" and len(got) == 4 and sum(v == "fill" for v in got.values()) == 2
    assert sampling.manifest_hash(42, "x", 3) == sampling.manifest_hash(42, "x", 3) != sampling.manifest_hash(43, "x", 3)


def test_calibration(spark):
    import random

    rng = random.Random(3)
    rows = [(z := rng.gauss(0, 3), rng.random() < 1 / (1 + math.exp(-(0.5 * z + 0.4)))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "z double, y boolean")
    slope, shift = learning.platt(df, "y", "z")
    assert abs(slope - 0.5) < 0.06 and abs(shift - 0.4) < 0.12
    t, nll = learning.best_temperature(df, "y", "z")
    assert 1.5 <= t <= 2.75 and 0 < nll < 0.7 and len(learning.TEMPERATURES) == 50


def test_networks_stacks_and_sweeps(spark):
    rows = [(f"{'solid round' if i % 2 else 'hazy glass'} nodule {i % 5}", "a" if i % 2 else "b", float(i % 2), float(i % 7)) for i in range(80)]
    df = spark.createDataFrame(rows, "t string, y string, p double, f double")
    model = learning.mlp_classifier(df, "t", "y", vocabulary=50, hidden=4, iterations=40)
    assert learning.predicted(model, df, "t").filter("y <> predicted_label").count() == 0
    st = learning.stacked(df, ["p", "f"], "p").transform(df)
    assert st.filter("prediction <> p").count() == 0
    s = learning.sweep(df, df, "t", "y", ["a", "b"], [{"vocabulary": 20}, {"vocabulary": 50, "kind": "svm"}]).collect()
    assert len(s) == 2 and all(r.accuracy == 1.0 for r in s)


def test_documents_and_rows(spark, tmp_path):
    (tmp_path / "d.csv").write_text('note_id,subject_id,note_text\n1-DS-1,7,"a\nb"\n')
    r = tables.read_discharge(spark, f"{tmp_path}/d.csv").first()
    assert (r.subject_id, r.text) == (7, "a\nb")
    tables.write_document(spark, {"k": ["é"]}, f"{tmp_path}/doc")
    assert tables.read_document(spark, f"{tmp_path}/doc/part-*.txt") == {"k": ["é"]}
    (tmp_path / "r").mkdir()
    for n in ("density_svm.json", "density_mlp.json", "other.json"):
        (tmp_path / "r" / n).write_text('{"x": 1}')
    assert sorted(r.variant for r in tables.read_results(spark, f"{tmp_path}/r", "density_").collect()) == ["mlp", "svm"]
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "z int, x int")
    tables.write_csv_union([a, b], f"{tmp_path}/u")
    u = spark.read.option("header", True).csv(f"{tmp_path}/u")
    assert u.columns == ["x", "y", "z"] and u.count() == 2
    rows = spark.createDataFrame([("c", "t"), ("d", " ")], "case_id string, mention_text string")
    assert tables.required_rows(rows, ["case_id"], source="f").first().source == "f"
    with pytest.raises(Exception, match="blank mention_text"):
        tables.required_rows(rows, ["mention_text"]).collect()
    with pytest.raises(ValueError):
        tables.required_rows(rows.limit(0), [])
    calls = []
    build = lambda: calls.append(1) or a
    assert [tables.cached(spark, f"{tmp_path}/c", build, force=f).count() for f in (False, False, True)] == [1, 1, 1] and len(calls) == 2
    p = spark.createDataFrame([("s", 0.5, "has_size")], "sample_id string, probability double, label string")
    assert tables.write_probabilities(p, f"{tmp_path}/p", split="val", source_path="v")["rows"] == 1


def test_the_rest_without_corpus_operators():
    """Nothing outside the corpus folder imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "notewright"
    assert not [f for f in root.rglob("*.py") if "llm" not in f.parts and ("notewright.llm" in f.read_text() or "from .llm" in f.read_text() or "..llm" in f.read_text())]
