import json

import pytest
from pyspark.sql import functions as F

from notewright.operators import adapter, bundles, graph, metrics, rules, sampling, validation, weak

NODULE = "case_id int, ordinal int, size_mm double, density_category string, density_text string, change_status string, change_text string, evidence_span string, recommendation_cue string, confidence string"


def nodule(case, size, density, change=None, span="a nodule", ordinal=0):
    return (case, ordinal, size, density, None, change, change, span, None, "high")


FLAT = [
    (5.0, "solid", None, "x", "2", "12_months"), (6.0, "solid", None, "x", "3", "6_months"), (10.0, "solid", None, "x", "4A", "3_months"), (16.0, "solid", None, "x", "4B", "immediate"),
    (29.0, "ground_glass", None, "x", "2", "12_months"), (30.0, "ground_glass", None, "x", "3", "6_months"), (5.0, "part_solid", None, "x", "2", "12_months"),
    (8.0, "part_solid", None, "solid component measuring 7 mm", "4A", "3_months"), (8.0, "part_solid", None, "solid component of 3 mm", "3", "6_months"), (8.0, "part_solid", None, "x", "4A", "3_months"),
    (5.0, "solid", "new", "x", "3", "6_months"), (10.0, "solid", "stable", "stable for two years", "2", "12_months"), (6.0, "solid", "increased", "x", "4A", "3_months"),
    (None, "solid", None, "x", None, None), (7.0, None, None, "x", "3", "6_months"), (3.0, "calcified", None, "x", "2", "12_months"), (10.0, "solid", "new", "x", "4A", "3_months"),
]


def test_flat_rules(spark):
    n = spark.createDataFrame([nodule(i, s, d, c, e) for i, (s, d, c, e, *_) in enumerate(FLAT)], NODULE)
    cases = spark.createDataFrame([(i, "eligible" if i % 2 else None) for i in range(len(FLAT) + 1)], "case_id int, smoking_eligible string")
    got = {r.case_id: r for r in rules.recommend(n, cases).collect()}
    for i, (size, density, _, _, category, interval) in enumerate(FLAT):
        assert (got[i].lung_rads_category, got[i].followup_interval) == (category, interval), FLAT[i]
        assert ("smoking_eligibility" in got[i].missing_information) == (i % 2 == 0)
        assert ("density_category" in got[i].missing_information) == (density is None and size is not None)
    assert got[len(FLAT)].recommendation_level == got[13].recommendation_level == "insufficient_data"
    assert got[16].recommendation_level == "diagnostic_workup" and got[1].input_facts_used.patient_risk_level == "high_risk"


def test_dominant(spark):
    n = spark.createDataFrame([nodule(1, 5.0, "solid", ordinal=0), nodule(1, 9.0, "solid", ordinal=1), nodule(1, 12.0, "solid", ordinal=2), nodule(1, 12.0, "part_solid", "new", ordinal=3)], NODULE)
    r = rules.recommend(n, spark.createDataFrame([(1, "eligible")], "case_id int, smoking_eligible string")).first()
    assert r.input_facts_used.nodule_size_mm == 12.0 and r.lung_rads_category == "4A" and r.input_facts_used.nodule_count == 4


def test_graph(spark):
    rows = [nodule(1, 10.0, "solid"), nodule(2, 12.0, "part_solid", span="solid component measuring 7 mm"), nodule(3, 30.0, "ground_glass"), nodule(4, None, "solid"), nodule(5, 7.0, None), nodule(6, 5.0, "solid"), nodule(7, 9.0, "cystic"), nodule(8, 7.0, None), nodule(8, 5.0, "solid", ordinal=1)]
    cases = spark.createDataFrame([(i, "eligible") for i in range(1, 10)], "case_id int, smoking_eligible string")
    got = {r.case_id: r for r in graph.execute(spark.createDataFrame(rows, NODULE), cases).collect()}
    assert got[1].lung_rads_category == "4A" and "SOLID_EXISTING_SIZE" in got[1].visited_nodes and "E_SOLID_8_14" in got[1].matched_edges and "E_SOLID_LT6" in got[1].failed_edges
    assert got[2].lung_rads_category == "4A" and got[3].lung_rads_category == "3" and got[6].terminal_node == "T_SOLID_LT6_CAT2"
    assert [got[i].abstention_reason for i in (4, 5, 7, 9)] == ["missing_nodule_size", "missing_nodule_density", "unsupported_nodule_density", "no_structured_nodule"]
    assert got[8].lung_rads_category == "2" and got[8].actionable_count == 1


def test_graph_agrees_with_rules(spark):
    rows = [nodule(i, float(s), d, c) for i, (s, d, c) in enumerate((s, d, c) for s in range(1, 40, 3) for d in ("solid", "part_solid", "ground_glass", "calcified") for c in (None, "new", "increased", "decreased", "stable"))]
    n, cases = spark.createDataFrame(rows, NODULE), spark.createDataFrame([(i, None) for i in range(len(rows))], "case_id int, smoking_eligible string")
    a = {r.case_id: (r.lung_rads_category, r.recommendation_level, r.followup_interval) for r in rules.recommend(n, cases).collect()}
    b = {r.case_id: (r.lung_rads_category, r.recommendation_level, r.followup_interval) for r in graph.execute(n, cases).collect()}
    assert a == b


def test_graph_conditions(spark):
    df = spark.createDataFrame([(1.0, "x", None), (None, "", "y")], "a double, b string, c string")
    holds = lambda spec: [r[0] for r in df.select(graph.condition(spec)[0]).collect()]
    gone = lambda spec: [r[0] for r in df.select(graph.condition(spec)[1]).collect()]
    assert holds({"op": "range", "fact": "a", "gte": 1, "lt": 2}) == [True, False] and holds({"op": "missing", "fact": "b"}) == [False, True]
    assert holds({"op": "missing_or_in", "fact": "b", "values": ["x"]}) == [True, True] and holds({"op": "nonsense", "fact": "a"}) == [False, False]
    both = [{"op": "exists", "fact": "a"}, {"op": "exists", "fact": "c"}]
    assert gone({"op": "all", "conditions": both}) == [["c"], ["a"]] and gone({"op": "any", "conditions": both}) == [[], []] and holds({"op": "any", "conditions": both}) == [True, True]


def test_graph_must_be_acyclic():
    with pytest.raises(ValueError):
        graph.Compiled({"entry_node": "a", "nodes": [{"node_id": "a"}, {"node_id": "b"}], "edges": [{"edge_id": "1", "from": "a", "to": "b", "condition": {"op": "always"}}, {"edge_id": "2", "from": "b", "to": "a", "condition": {"op": "always"}}]})
    assert json.dumps(graph.lung_graph())


def votes(*pairs):
    return [(f"L{i}", label, conf, label) for i, (label, conf) in enumerate(pairs, 1)]


VOTES = [
    (votes((None, 0.0), (None, 0.0)), None, "__ABSTAIN__", 0.0, 0.0, []),
    ([], None, "__ABSTAIN__", 0.0, 0.0, []),
    (votes(("a", 1.0), ("a", 0.5)), None, "a", 1.0, 1.0, ["G1", "G2", "G3", "G4", "G5"]),
    (votes(("a", 1.0), ("a", 1.0), ("b", 1.0)), None, "a", 0.6667, 0.6667, ["G1", "G3"]),
    (votes(("a", 1.0), ("b", 1.0)), {"L1": 0.3, "L2": 0.9}, "b", 0.75, 0.5, ["G1", "G2", "G3"]),
    (votes(("b", 1.0), ("a", 1.0)), None, "b", 0.5, 0.5, ["G1", "G3"]),
]


@pytest.mark.parametrize("details,weights,label,confidence,agreement,passed", VOTES)
def test_votes(spark, details, weights, label, confidence, agreement, passed):
    df = spark.createDataFrame([(details,)], "lf_details array<struct<lf_name:string,label:string,confidence:double,evidence_span:string>>")
    r = weak.aggregate_votes(df, "x", weights=weights or {"none": 1.0}).first()
    assert (r.ws_label, r.ws_confidence, r.lf_agreement, r.passed_gates) == (label, confidence, agreement, passed)
    assert r.gate_level == (passed[-1] if passed else "REJECTED")


def test_labelling_functions(spark):
    rows = [
        (1, "4 mm solid nodule in the right upper lobe and left lower lobe", "x", "findings"), (2, "part-solid nodule, no evidence of calcified lesion", "IMPRESSION: a nodule. solid nodule.", "findings"),
        (3, None, None, None), (4, "", "", ""), (5, "tiny nodule", "in the RUL there is a tiny nodule", "impression"), (6, "scattered throughout both lungs, right-sided", "", ""),
    ]
    m = spark.createDataFrame(rows, "i int, mention_text string, full_text string, section string")
    got = {t: {r.i: [x.label for x in r.lf_details] for r in weak.label_rows(m, t).collect()} for t in ("density", "size", "location")}
    assert got["density"][1] == ["solid", None, None, None, None] and got["density"][2] == ["part_solid", None, "unclear", "unclear", "solid"]
    assert got["density"][3] == got["density"][4] == got["location"][3] == got["location"][4] == [None] * 5
    assert got["size"][1][0] == "true" and got["size"][5] == [None, None, None, "true", None] and got["size"][4][4] == "false"
    assert got["location"][1] == ["RUL", "bilateral", None, None, None] and got["location"][5][4] == "RUL" and got["location"][6][:4] == ["bilateral", None, "bilateral", "unclear"]


def test_bundles(spark):
    n = "struct<size_mm:double,density_category:string,recommendation_cue:string,confidence:string>"
    facts = spark.createDataFrame(
        [("1-RR-2", 1, 2, [(5.0, "solid", "follow-up", "high")]), ("1-RR-1", 1, 1, [(None, "unclear", None, "low")]), ("2-RR-1", 2, 1, [(None, "unclear", None, "low")]), ("3-RR-1", 3, 1, [(4.0, "solid", None, "medium")]), ("4-RR-1", 4, 1, [])],
        f"note_id string, subject_id int, ordinal int, nodules array<{n}>",
    )
    smoke = spark.createDataFrame([(1, "d", "high"), (3, "e", "low")], "subject_id int, note_id string, evidence_quality string")
    who = spark.createDataFrame([(1, 67, "female", "WHITE", "Medicare", "t"), (2, 50, "other", None, None, "t")], "subject_id int, age int, sex string, race string, insurance string, source string")
    got = {r.subject_id: r for r in bundles.assemble(facts, smoke, who).collect()}
    assert [got[i].label_quality for i in (1, 2, 3, 4)] == ["silver", "unlabeled", "weak", "unlabeled"]
    assert got[1].case_id == "CASE-1-001" and [f.note_id for f in got[1].radiology_facts] == ["1-RR-1", "1-RR-2"] and got[1].demographics.sex == "F" and got[1].demographics.missing_flags == []
    assert got[3].demographics.missing_flags == ["age", "sex", "race", "insurance", "source"] and got[1].recommendation_target.ground_truth_source == "extracted_from_report"


def test_splits(spark):
    for n in (1, 2, 3, 10, 137):
        rows = spark.range(n).withColumnRenamed("id", "k")
        parts = {r.split: r.c for r in sampling.subject_split(rows.union(rows), "k").groupBy("split").agg(F.count("*").alias("c")).collect()}
        assert sum(parts.values()) == n and (n < 3 or set(parts) == {"train", "val", "test"})
    assert parts == {"train": 95, "val": 20, "test": 22}
    groups = spark.createDataFrame([(i, "a" if i < 20 else "b" if i < 22 else "c") for i in range(23)], "k int, l string")
    got = {(r.l, r.split): r.c for r in sampling.label_split(groups, "k", "l").groupBy("l", "split").agg(F.count("*").alias("c")).collect()}
    assert got == {("a", "train"): 14, ("a", "val"): 3, ("a", "test"): 3, ("b", "train"): 1, ("b", "test"): 1, ("c", "train"): 1}


def test_shares_are_decimal(spark):
    """0.7 * 90 and 0.7 * 45 are a little less than 63 and 31.5 in binary."""
    rows = spark.range(90).withColumnRenamed("id", "k")
    assert sampling.subject_split(rows, "k").filter("split = 'train'").count() == 63
    assert sampling.label_split(rows.filter("k < 45").withColumn("l", F.lit("a")), "k", "l").filter("split = 'train'").count() == 32


def test_greedy(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 5) for i in range(30)], "k int, a int, b int")
    got = sampling.greedy_strata(rows, "k", [("zero", F.col("a") == 0, [F.asc("k")]), ("one", F.col("b") == 0, [F.asc("k")])], 3, 10).collect()
    assert len({r.k for r in got}) == len(got) == 10 and [r.k for r in got if r.stratum == "zero"] == [0, 3, 6] and [r.k for r in got if r.stratum == "one"] == [5, 10, 15]


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a", 0.9, True), ("a", "b", 0.8, False), ("b", "b", 0.8, True), ("c", "a", 0.1, False)], "t string, p string, s double, y boolean")
    s = metrics.summary(rows, "t", "p", ["a", "b", "z"]).first()
    assert s.accuracy == 0.5 and round(s.macro_f1, 6) == round((0.5 + 2 / 3 + 0) / 3, 6)
    r = metrics.ranking(rows, "y", "s").first()
    assert r.auroc == 0.875 and round(r.average_precision, 6) == round(0.5 * 1 + 0.5 * 2 / 3, 6)
    assert metrics.best_threshold(rows, "y", "s").first().threshold == 0.8
    one = metrics.ranking(rows.filter("y"), "y", "s").first()
    assert one.auroc is None and one.average_precision is None
    assert metrics.seed_summary(rows.limit(1), ["t"], "s").first()["std"] == 0.0
    assert metrics.confusion(rows, "t", "p", ["a", "b"]).count() == 4


def test_adapter(spark):
    p = spark.createDataFrame(
        [("s1", "n1", "lung nodule", "size", "5", 0.9, 1), ("s1", "n1", "later", "size", "6", 0.8, 2), ("s1", "n1", "x", "density", "solid", 0.7, 3), ("s2", None, "lung nodule", "size", "5", 0.9, 1), ("s3", "n9", "lung", "size", "5", 0.9, 1), ("s4", "n1", "thyroid nodule", "size", "5", 0.9, 1), ("s5", "n1", "lung", "size", None, 0.9, 1)],
        "sample_id string, note_id string, mention_text string, task string, label string, confidence double, ordinal int",
    )
    m = adapter.merge_tasks(p, ["size", "density", "location"])
    first = m.filter("sample_id = 's1'").first()
    assert (first.mention_text, first["size"].label, first.density.label, first.location) == ("lung nodule", "6", "solid", None)
    routed = {r.sample_id: r.reason for r in adapter.routed(m, spark.createDataFrame([("n1", 1)], "note_id string, case_id int")).collect()}
    assert routed == {"s1": None, "s2": "missing_note_id", "s3": "note_id_not_in_case_bundle", "s4": "non_pulmonary_mention_filtered", "s5": "no_direct_fact"}
    c = spark.createDataFrame([(1, "n1", "a", 1, 5.0, "solid", 0.9), (1, "n1", "b", 2, 0.0, "part_solid", 0.9), (1, "n2", "c", 9, 7.0, None, 0.5)], "case_id int, note_id string, sample_id string, ordinal int, size_mm double, density string, confidence double")
    assert {r.sample_id: r.candidate_rank for r in adapter.ranked_candidates(c).collect()} == {"a": 1, "b": 2, "c": 1}
    assert adapter.nearest_density(c).first().density == "part_solid"
    assert adapter.conflicts(c, ["density"]).first().alternatives == "part_solid|solid"


def test_validation(spark):
    df = spark.createDataFrame([("1-RR-1", 1, 0, "CT", "chest"), ("bad", 0, -1, "XX", None), (None, None, None, None, None)], "note_id string, subject_id int, nodule_count int, modality string, body_site string")
    got = [len(r.errors) for r in validation.validate(df, validation.fact_rules()).collect()]
    assert got == [0, 4, 2]
