"""Edges that all corpus operators share: repeated rows, very long texts, other types of ids, taken names, nothing at all."""

import random
import time

import pytest
from pyspark.sql import functions as F

from notewright.llm import common
from notewright.llm.decontaminate import decontaminate
from notewright.llm.line_dedup import line_dedup
from notewright.llm.lm_score import lm_scores
from notewright.llm.mixing import mix_sources
from notewright.llm.near_dedup import near_duplicate_groups
from notewright.llm.pii import pii_spans
from notewright.llm.quality import quality_scores, train_quality
from notewright.llm.secret_scan import secret_scan
from notewright.llm.substring_dedup import substring_dedup

from . import brute
from .test_operators import prose

ITEM = "the very words of an item that a document may hold somewhere"


def everything(spark, docs):
    """Each operator's rows: name -> DataFrame with doc_id."""
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    model = train_quality(docs.select("doc_id", "text"), docs.select("doc_id", F.lit(1).alias("quality")), F.lit(True))
    return {
        "secrets": secret_scan(docs), "substrings": substring_dedup(docs, window=35, digest=True), "lines": line_dedup(docs), "scores": lm_scores(docs, F.lit(False)), "items": decontaminate(docs, items),
        "quality": quality_scores(docs, model), "personal": pii_spans(docs, digest=True), "groups": near_duplicate_groups(docs),
    }


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeated_rows_and_ids(spark, kind):
    """Rows that repeat an id, or all of a row, stay rows; ids may be text; other columns may be called anything."""
    rng = random.Random(51)
    secret, mail = "token=abcdefgh12345678", "jo@corp.example"
    texts = [f"{prose(rng, 40)} {secret} {mail}", f"{prose(rng, 50)} {ITEM}", prose(rng, 30), None, ""]
    rows = [(i % 3, t, "s", "x", 1.0, "y") for i, t in enumerate(texts * 3)] + [(None, texts[0], None, None, None, None)]
    docs = spark.createDataFrame([(None if r[0] is None else str(r[0]) if kind == "string" else r[0], *r[1:]) for r in rows], f"doc_id {kind}, text string, source string, spans string, score double, blk string")
    for name, got in everything(spark, docs).items():
        assert got.count() == len(rows), name
        assert dict(got.schema["doc_id"].jsonValue())["type"] == kind, name
    by = everything(spark, docs)
    assert by["secrets"].filter("n_assign = 1").count() == by["personal"].filter("n_email = 1").count() == 4
    assert by["items"].filter("size(nw_matches) = 1").count() == 3
    assert sorted(r.n_words for r in by["substrings"].collect()) == sorted(n for _, n, *_ in brute.removed([(r[0], r[1]) for r in rows], 35))


def test_very_long_texts(spark):
    """Texts of 200,000 words, of one line or one word, among short ones: whole results in bounded time."""
    rng = random.Random(52)
    many = prose(rng, 200_000, 50_000)
    middle = len(many) // 2
    holds = f"{many[:middle]} {ITEM} password: {'q' * 12} jo@corp.example {many[middle:]}"
    rows = [(0, holds, "a"), (1, f"{many} end", "b"), (2, "z" * 1_000_000, "a"), (3, "1" * 300_000, "a"), (4, "\n" * 100_000, "b"), (5, "short one", "b"), (6, "a b " * 100_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    start = time.time()
    by = {name: {r.doc_id: r for r in df.collect()} for name, df in everything(spark, docs).items()}
    assert time.time() - start < 300 and all(len(v) == len(rows) for v in by.values())
    assert by["secrets"][0].n_assign == 1 and by["personal"][0].n_email == 1 and len(by["items"][0].nw_matches) == 1 and not by["items"][1].nw_matches
    assert by["groups"][1].component_id == 0 and by["substrings"][0].n_removed > 199_000 and by["scores"][0].n_tokens > 200_000
    assert by["lines"][4].nw_lines == 100_001 and by["lines"][4].nw_dropped == 0
    assert [(s.kind, s.start) for s in by["personal"][0].all_spans] == [("email", holds.index("jo@corp"))]


def test_taken_names(spark):
    docs = spark.createDataFrame([(1, "a", "s", 2, 3)], "doc_id long, text string, source string, copy int, nw_score int")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for run in (lambda: mix_sources(docs), lambda: line_dedup(docs), lambda: decontaminate(docs, items)):
        with pytest.raises(ValueError, match="taken"):
            run()
    with pytest.raises(ValueError, match="copy"):
        mix_sources(docs.drop("nw_score"))


def test_nothing_at_all(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(df.count() == 0 for df in everything(spark, docs).values())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import corpus_pipeline

    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", "s")] * 3 + [(i, "b", "s") for i in range(2, 200)], "doc_id long, text string, source string")
    counts = [r["count"] for r in mix_sources(docs).filter("doc_id = 1").groupBy("copy").count().collect()]
    assert all(c == 3 for c in counts)


def test_common_keys_are_dealt_out(spark):
    left = spark.range(5000).select((F.col("id") % 7).alias("k"), "id").union(spark.range(3000).select(F.lit(99).cast("long"), "id"))
    right = spark.createDataFrame([(99, "hot"), (1, "x")], "k long, v string")
    hot = common.hot_keys(left.groupBy("k").count(), "k", "count", 8000)
    assert 99 in hot
    got = common.salted_join(left, right, "k", [99], F.col("id"))
    assert got.count() == left.join(right, "k").count() and got.columns == ["k", "id", "v"]


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(k, d=None):
                return d

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def test_lines_are_removed_in_linear_time(spark):
    """One text of 40,000 recurring lines beside plain ones: what is dropped is found by a set."""
    many = "\n".join(f"notice of page {i} here" for i in range(40_000))
    rows = [(0, many)] + [(i, f"{prose(random.Random(i), 40, 9000)}\nnotice of page 7 here") for i in range(1, 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: (r.nw_lines, r.nw_dropped, r.text) for r in line_dedup(docs).collect()}
    assert time.time() - start < 60
    assert got[0] == (40_000, 40_000, "") and all(got[i][1] == 1 and got[i][2] == rows[i][1].split("\n")[0] for i in range(1, 15))


def test_a_value_that_half_the_documents_hold(spark):
    """A common secret and a common term are dealt out; results are those of the plain rule."""
    rows = [(i, f"token=commonvalue123 page {i} token=own{i:08}x", f"o{i % 9}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secret_scan(docs).select("doc_id", "n_live", "n_example").collect()
    assert len(got) == 1200 and {(r.n_live, r.n_example) for r in got} == {(1, 1)}
    people = [(i, f"the report of case {i} {' '.join(f'x{j * 7 + i % 5}' for j in range(20))} the end {'jo@corp.example nickname' + str(i % 3) if i % 40 == 0 else ''}") for i in range(1200)]
    found = {r.doc_id: r.n_email for r in pii_spans(spark.createDataFrame(people, "doc_id long, text string"), digest=True).collect()}
    assert len(found) == 1200 and sum(found.values()) == 30
