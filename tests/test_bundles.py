"""Bundles' labels and recommendations without gathering, against gathered bundles."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from notewright.operators import bundles, radiology, rules, smoking
from notewright.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = (
    "FINDINGS: A 5 mm solid nodule in the right upper lobe. It is stable for two years.\nIMPRESSION: Follow-up CT in 6 months.",
    "FINDINGS: No nodules identified.\nIMPRESSION: Normal.",
    "FINDINGS: Clear.\nIMPRESSION: A 12 x 9 mm part-solid nodule in the lingula, new. Follow-up is suggested.",
    "FINDINGS: Effusion.\nIMPRESSION: Normal.",
    "FINDINGS: A 21 mm ground-glass nodule, right lung. A 9 mm new opacity in the left lower lobe. It has increased in size.",
    "FINDINGS: A nodule.\nIMPRESSION: Lung-RADS category: 2.",
    None,
)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"{s}-RR-{k}", s, k * 10 + s, "CT CHEST", TEXTS[(s * 5 + k * k) % len(TEXTS)]) for s in range(1, 40) for k in range(1 + s % 4)]
    notes = spark.createDataFrame(rows, "note_id string, subject_id long, ordinal long, exam_name string, text string")
    social = ("Current smoker, 30 pack-year history", "Denies tobacco use", "Lives alone", "Smokes")
    stays = [(s, f"{s}-DS-{k}", k, f"Social History: {social[(s + k) % 4]}\nFamily History: none") for s in range(1, 40) if s % 5 for k in range(3)]
    return notes, spark.createDataFrame(stays, "subject_id long, note_id string, ordinal long, text string")


def test_labels_and_recommendations_are_those_of_gathered_bundles(spark, tables):
    notes, stays = tables
    first = bundles.first_per_subject(smoking.smoking_facts(stays))
    who = notes.select("subject_id", *[F.lit(None).cast("string").alias(c) for c in ("age", "sex", "race", "insurance", "source")]).distinct()
    b = bundles.assemble(radiology.facts(notes).select("note_id", "subject_id", "ordinal", "nodules"), first, who)
    cases = b.select("case_id", F.col("smoking_eligibility.eligible_for_high_risk_screening").alias("smoking_eligible"))
    want = bundles.downgraded(b, rules.recommend(bundles.case_nodules(b), cases))

    m = rules.judged(radiology.mentions_cut(notes)).withColumn("ordinal", F.col("ordinal") * 100_000 + F.col("nodule_id_in_report"))
    known = F.col("nodule_id_in_report").isNotNull()
    n = bundles.labelled(m, smoking.smoking_facts(bundles.first_per_subject(stays)), nodule_count=F.count_if(known), d=rules.dominant(known))
    r = rules.recommend_dominant(n.withColumn("smoking_eligible", F.col("smoking_eligibility.eligible_for_high_risk_screening")), ["label_quality", "smoking_eligibility"])
    kept = ("case_id", "label_quality", "smoking_eligibility")
    got = bundles.downgrade(r.select(*kept, F.struct(*[c for c in r.columns if c not in kept]).alias("recommendation_output")))
    rows = [sorted(df.select("case_id", "label_quality", "smoking_eligibility", "recommendation_output").collect(), key=lambda x: x.case_id) for df in (got, want)]
    assert rows[0] == rows[1] and {x.label_quality for x in rows[0]} >= {"silver", "weak", "unlabeled"}


def test_mentions_in_batches_are_mentions_in_columns(tables):
    notes, _ = tables
    key = lambda r: (r.note_id, r.nodule_id_in_report)
    got = radiology.mentions_cut(notes).drop("ordinal", "lung_rads_category", "missing_flags")
    each = radiology.mention_facts(notes).select(got.columns)
    assert sorted(got.filter("nodule_id_in_report is not null").collect(), key=key) == sorted(each.collect(), key=key)
    assert got.select("note_id").distinct().count() == notes.count()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_bundles_are_validated_in_one_pass(spark):
    """Notes are made once, and their texts are neither shuffled nor gathered."""
    plan = QUERIES["bundle_validation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") == 1 and "RebalancePartitions" not in plan and "collect_list" not in plan
