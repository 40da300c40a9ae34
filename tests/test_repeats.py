"""Texts that many rows have are read once."""

from pyspark.sql import functions as F

from notewright.operators import radiology, repeats


def test_each_text_is_read_once_and_dealt_to_all_its_rows(spark):
    rows = [(i, f"text {i % 5}" if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(6)
    met = repeats.by_text(df, "text")
    assert met.count() < 60  # six texts, null is one, in a few tasks
    got = repeats.dealt(met.withColumn("n", F.length("text"))).collect()
    assert sorted((r.id, r.n) for r in got) == [(i, t and len(t)) for i, t in rows]


def test_facts_once_are_facts(spark):
    text = "FINDINGS: A 5 mm solid nodule in the right upper lobe. It is stable.\nIMPRESSION: Follow-up CT."
    rows = [(f"1-RR-{i}", 1, "CT CHEST", text if i % 3 else "FINDINGS: Normal.") for i in range(30)]
    notes = spark.createDataFrame(rows, "note_id string, subject_id long, exam_name string, text string")
    read = lambda df: sorted((r.note_id, r.nodule_count, r.nodules) for r in df.collect())
    assert read(radiology.facts_once(notes)) == read(radiology.facts(notes))
    once, each = (sorted(df.select("note_id", "size_mm", "change_status").collect()) for df in (radiology.mentions_once(notes), radiology.mention_facts(notes)))
    assert once == each and len(once) == 20
