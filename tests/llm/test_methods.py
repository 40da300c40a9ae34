"""What each method adds beyond its base, against plain versions: live tokens, disclosing terms, rule scores, and the pipeline's stages."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from notewright.llm.pii import pii_spans
from notewright.llm.quality import quality_scores, train_quality
from notewright.llm.secret_scan import MAX_OWNERS, MAX_REPOS, secret_scan
from notewright.llm.sql import OP3, OP6

from . import brute
from .test_operators import prose, words_of


@pytest.mark.parametrize("seed", [1, 2])
def test_live_tokens(spark, seed):
    rng = random.Random(seed)
    token = lambda: "".join(rng.choice("ABCDEFghijkl0123456789_") for _ in range(rng.choice([18, 20, 24, 40])))
    shared = [token() for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [prose(rng, 5)]
        for _ in range(rng.randrange(4)):
            v = rng.choice(shared[: rng.choice([2, 12])]) if rng.random() < 0.6 else token()
            parts.append(rng.choice([v, f"password={v}", f"see {v}, é", f"AKIA{'Q' * 16}", "deadbeef" * 5]))
        rows.append((i, " ".join(parts), rng.choice(["a", "b", "c", None])))
    want = brute.live_tokens(rows, brute.secrets, MAX_OWNERS, MAX_REPOS)
    got = secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert {r.doc_id: (r.spans, r.verdicts) for r in got} == want
    assert any("live:" in s for s, _ in want.values()) and any("example" in v for _, v in want.values())
    for r in got:
        verdicts = [v.rsplit(":", 1)[1] for v in r.verdicts.split(",") if v]
        assert (r.n_live, r.n_example) == (verdicts.count("live"), verdicts.count("example"))


@pytest.mark.parametrize("seed", [3, 4])
def test_disclosure(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        who = rng.randrange(8)
        words = prose(rng, 30, 3000).split()
        for w in (f"name{who}", f"firm{who % 4}", f"town{who % 2}"):
            if rng.random() < 0.85:
                words.insert(rng.randrange(len(words)), w)
        words.insert(rng.randrange(len(words)), f"who{who}@corp.example" if rng.random() < 0.8 else "+1 555 010 99{:02d}".format(who))
        rows.append((i, " ".join(words)))
    copy = rows[0][1]
    rows += [(200 + k, f"{copy} edit{k}") for k in range(5)]
    want = brute.disclosing(rows, brute.personal, 3, 0.85, 0.95)
    got = pii_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    added = {r.doc_id: sorted((s.kind, s.start, s.end) for s in r.all_spans if s.kind in ("general", "remove")) for r in got}
    assert added == want and sum(map(len, want.values())) > 20
    for r in got:
        text = dict(rows)[r.doc_id]
        assert not [w for k, a, b in added[r.doc_id] if k == "remove" and (w := text[a:b]) in r.sanitised_text.split()]


def test_rules_from_scratch(spark):
    """A score is the logistic of the bias and the weights of the rules that hold, on statistics counted in plain Python."""
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 80)) if i % 3 else "Ünï|| #1 <b> {x} " * rng.randrange(1, 20), int(i % 3 > 0)) for i in range(240)] + [(900, None, 0), (901, "", 0), (902, "\n\n.", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = train_quality(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.nw_score for r in quality_scores(docs, model).collect()}
    for i, t, _ in rows:
        x = brute.text_statistics(t)
        z = model.bias + sum(r.weight for r in model.rules if all((x[n] > c) if above else (x[n] <= c) for n, above, c in r.parts))
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9), (i, t)


def test_pipeline_stages_one_by_one(spark, tmp_path):
    """Every stage gives what its plain version gives of the rows that the stage before it kept."""
    import corpus_pipeline

    rng = random.Random(61)
    item = words_of(rng, 20)
    texts = [words_of(rng, 60) for _ in range(80)]
    texts = [f"Shared banner of all\n{t}" if i % 3 else t for i, t in enumerate(texts)]
    texts[10] = f"{texts[10]}\n{item}"
    texts += [texts[4], f"{texts[5]} tail", None, "", *(f"||| {words_of(rng, 2)} ### !!!" * 20 for _ in range(40))]
    rows = [(i, t, "en", "hot" if i % 2 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 84), 0) for i in range(110)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted((tuple(r) for r in docs.collect()), key=repr))
    con = duckdb.connect()

    def sql(text, k):
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/*.parquet'")
        return con.execute(text).fetchall()

    assert {r[0] for r in kept[0]} >= set(range(82)) and not [r for r in kept[0] if r[0] >= 84]
    assert sorted((r[0], r[1]) for r in kept[1] if r[1] is not None) == sorted((r[0], r[3]) for r in sql(OP3, 0) if r[3] is not None)
    assert not [r for r in kept[1] if "banner" in (r[1] or "")] and all(r[4] == len(r[1]) for r in kept[1] if r[1])
    first = {i for i, _, c in ((i, n, c) for (i, *_), (_, n, c) in zip(kept[1], brute.groups([(r[0], r[1]) for r in kept[1]], 5, 80), strict=True)) if i == c}
    assert [r[0] for r in kept[2]] == [r[0] for r in kept[1] if r[0] in first]
    held = {d for d, _ in brute.contaminated([(r[0], r[1]) for r in kept[2]], [(7, item)])}
    assert held == {10} and kept[3] == [r for r in kept[2] if r[0] not in held]
    assert sorted(map(repr, kept[4])) == sorted(map(repr, sql(OP6, 3)))
