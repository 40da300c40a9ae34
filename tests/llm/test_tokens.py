"""Source divergence, packing and token alignment against plain versions, and their edges."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notewright.llm import alignment, divergence, packing, tokens
from notewright.llm.alignment import align_tokens, group_products, token_groups
from notewright.llm.divergence import greatest, source_divergence
from notewright.llm.packing import Packer, pack_examples

from . import brute
from .test_operators import prose

FILES = {"byte_level": P.path("byte_bpe_50k.json"), "pieces": P.path("piece_bpe_32k.model")}
WORDS = P.path("word_bpe_49k.json")
#: Texts at which tokenizers differ, or which can't be cut anywhere.
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "  two  spaces ", "tab\tand\r\nline", "line\nline\n\nline\n", "don't we'll it's 'S", "x y z 　w", "café été naïve über",
    "é ́x combining", "日本語 と text", "\U0001f600 smile\U0001f600", "<|endoftext|> <s></s> <unk> <0x41>", "▁ lower ▁block", "ﬁligature Å", "\x00nul \x1f \x7f", "1234567890 12 1 000", "z" * 3000,
    "İstanbul ΣΣ", "a\n b\n\tc", "word. \"quoted\", (so) - on... !!!", "<|startoftext|>word<|ENDOFTEXT|>",
]


def pairs_of(seed=3, n=25):
    rng = random.Random(seed)
    texts = ODD + [prose(rng, rng.choice([1, 5, 40])).replace("w1", "café").replace(" w2", "\nw2") for _ in range(n)]
    return [*enumerate(texts), (3, texts[-1]), (None, texts[-2])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in pairs_of()], "doc_id long, text string, blk int, codes string, n_a int").repartition(3)


@pytest.fixture(scope="module")
def plain():
    both = alignment.Pair(FILES["byte_level"], FILES["pieces"])

    def ids(t):
        a, b = both.a.encode(f" {t}", add_special_tokens=False).ids, both.b.encode(t)
        return a, [both.bytes_a[i] for i in a], b, [both.bytes_b[i] for i in b]

    return ids


KEY = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("block", [1, 500, 8 << 20])
def test_alignment(docs, plain, block):
    got = sorted((tuple(r) for r in align_tokens(docs, **FILES, block=block).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=KEY)
    want = brute.alignment(pairs_of(), plain)
    assert got == sorted(want, key=KEY)
    assert sum(r[1] == 0 for r in want) >= 3  # nothing, or changed by a tokenizer


def test_token_bytes(plain):
    """Each vocabulary's bytes are those that its own decoder gives."""
    both = alignment.Pair(FILES["byte_level"], FILES["pieces"])
    t = "café 日本 \U0001f600 <x>\n\tend"
    a, a_bytes, b, b_bytes = plain(t)
    assert b"".join(a_bytes).decode() == f" {t}" == both.a.decode(a) and b"".join(b_bytes).decode() == f" {t}"
    assert both.b.decode(b) == t


def test_groups(spark, docs, plain):
    groups = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in token_groups(docs.filter("doc_id > 3"), **FILES).collect()}
    for i, t in pairs_of():
        if i is not None and i > 3:
            a, a_bytes, b, b_bytes = plain(t)
            if b"".join(a_bytes) == b"".join(b_bytes) == f" {t}".encode():
                assert [x for g, _ in groups[i] for x in g] == a and [x for _, g in groups[i] for x in g] == b
    one = spark.createDataFrame([([([1, 2], [7]), ([3], [7, 8])],), ([([1], [7])],)], "groups array<struct<a:array<int>,b:array<int>>>")
    assert {(r.a, r.b): r.n for r in group_products(one).collect()} == {(1, 7): 2, (2, 7): 1, (3, 7): 1, (3, 8): 1}


def test_units_are_whole_texts(monkeypatch):
    """Units put together give the ids of the whole text, for any size of chunk and after units are forgotten."""
    monkeypatch.setattr(tokens, "CHUNK", 64)
    monkeypatch.setattr(tokens, "KEPT", 5)
    coder = packing.Encoder(WORDS)
    rng = random.Random(5)
    for t in [x for x in ODD if x] + [prose(rng, 300), "y" * 500 + " " + prose(rng, 50)]:
        want = coder.tokenizer.encode(t, add_special_tokens=False).ids
        assert coder.encode([t.encode()])[0].tolist() == want and coder.encode([t.encode(), b"", b"more text"])[0].tolist() == want
        assert b"".join(tokens.chunks(t.encode(), 32)) == t.encode()


def packed_is_right(rows, texts, coder, length, segments, loss, prompts=None):
    """Every id in one piece, sequences within their limits and without gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    from_loss = {}
    for i, t in texts.items():
        of = lambda x: coder.encode(x or "", add_special_tokens=False).ids
        before = of(prompts[i]) if prompts else []
        want, at = [*before, *of(t), packing.END], 0
        from_loss[i] = len(before)
        for r in sorted(by_doc[i], key=lambda r: r.start):
            ids = want[r.start : r.start + r.length]
            assert r.start == at and r.length == len(ids) > 0 and r.doc_tokens == len(want)
            assert (r.ids == ids) if "ids" in r else r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += r.length
        assert at == len(want)
    sizes = []
    for some in by_sequence.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == [0, *np.cumsum([r.length for r in some]).tolist()[:-1]]
        sizes.append(sum(r.length for r in some))
        assert sizes[-1] <= length and len(some) <= segments
        assert sum(max(0, r.start + r.length - max(r.start, from_loss[r.doc_id])) for r in some) <= loss
    return sizes


@pytest.mark.parametrize("digest,pool", [(True, 1), (False, 1 << 20), (True, 700)])
def test_packing(spark, digest, pool):
    rng = random.Random(8)
    texts = {i: t for i, t in enumerate([*ODD, *[prose(rng, rng.choice([1, 2, 30, 200, 900])) for _ in range(60)]])}
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in texts.items()], "doc_id long, text string, start int, ids int, prompt string").repartition(2)
    coder = packing.Encoder(WORDS).tokenizer
    sizes = packed_is_right(pack_examples(docs, tokenizer=WORDS, length=256, digest=digest, pool=pool).collect(), texts, coder, 256, packing.SEGMENTS, 256)
    assert all(n & (n - 1) == 0 for n in sizes)  # nothing to pad
    assert sum(n < 256 for n in sizes) <= 2 * 8


@pytest.mark.parametrize("segments,loss", [(2, 64), (50, 20), (1, 1), (3, 30)])
def test_packing_within_all_limits(spark, segments, loss):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([1, 9, 40, 120])), prose(rng, rng.choice([0, 5, 60])) if i % 3 else None) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt string").repartition(2)
    got = pack_examples(docs, tokenizer=WORDS, length=64, segments=segments, loss=loss, prompt_col="prompt").collect()
    packed_is_right(got, {i: t for i, t, _ in rows}, packing.Encoder(WORDS).tokenizer, 64, segments, loss, {i: p for i, _, p in rows})


def test_packing_takes_the_greatest_product():
    packer = Packer(10, 9, 10)
    for n, loss_from in ((6, 0), (4, 4), (4, 0), (3, 0)):
        list(packer.add(n * 10 + loss_from, np.arange(n), loss_from))
    rows = list(packer.pack(True))
    first = [r[0] for r in rows if r[5] == 0]
    assert first == [60, 40]  # six and then, of the fours, the one with loss
    assert [sum(r[2] for r in rows if r[5] == s) for s in range(packer.sequence)] == [10, 4, 2, 1] and not packer.waiting
    with pytest.raises(ValueError, match="positive"):
        pack_examples(None, tokenizer=WORDS, segments=0)


def sources(seed=4, n=120):
    rng = random.Random(seed)
    rows = [(prose(rng, rng.choice([0, 3, 30, 80]), 150).replace("w", rng.choice(["w", "W", "é", "_"])), rng.choice(["en", "de", None, "x"]), rng.choice(["a", "b", "é", None, "hot", "hot"])) for _ in range(n)]
    return [*rows, (None, "en", "empty"), ("", "en", "a"), ("rare words only", "la", "a"), ("others here", "la", "b"), ("one alone", "fr", "a"), *[rows[0]] * 3]


@pytest.mark.parametrize("few,block_rows", [(1000, 100_000), (0, 20), (2, 7)])
def test_divergence(spark, monkeypatch, few, block_rows):
    monkeypatch.setattr(divergence, "FEW", few)
    docs = spark.createDataFrame([(i, *r, 1, "y") for i, r in enumerate(sources())], "doc_id long, text string, lang string, source string, n int, term string").repartition(3)
    for top in (200, 4):
        got = sorted(tuple(r) for r in source_divergence(docs, top=top, block_rows=block_rows).collect())
        assert got == brute.divergence(sources(), top=top)


def test_greatest(spark, monkeypatch):
    """Radix select is a sort: ties by bytes, values up to 2**60, groups smaller than k."""
    monkeypatch.setattr(divergence, "FEW", 3)
    rng = random.Random(6)
    rows = [("l", f"s{rng.randrange(3)}", f"{rng.choice(['aa', 'aaa', 'é', ''])}t{i}", rng.choice([0, 7, 7, 7, 1 << 45, (1 << 60) - 1, rng.randrange(1 << 60)])) for i in range(300)] + [("l", "few", "one", 5)]
    values = spark.createDataFrame(rows, "lang string, source string, term string, value long").repartition(3)
    for top in (1, 20, 200):
        got = sorted((r.source, r["rank"], r.term, r.value) for r in greatest(values, top).collect())
        want = []
        for s in {r[1] for r in rows}:
            some = sorted(((-v, t.encode(), t) for _, x, t, v in rows if x == s))[:top]
            want += [(s, k, t, -v) for k, (v, _, t) in enumerate(some, 1)]
        assert got == sorted(want)


def test_shares_are_exact(spark):
    rows = [(0, 1), (10**12, 10**12 + 7), (10**15, 3 * 10**15), (6, 7)]
    df = spark.createDataFrame(rows, "n long, total long").select("n", "total", F.expr(divergence.share("n", "total")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.total for r in df.collect())


def test_nothing_and_other_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert not align_tokens(empty, **FILES).count() and not pack_examples(empty, tokenizer=WORDS).count() and not source_divergence(empty).count()
    named = spark.createDataFrame([("a", "some words", "en", "s"), (None, None, None, None)], "doc_id string, text string, lang string, source string")
    assert {r.doc_id for r in align_tokens(named, **FILES).collect()} == {r.doc_id for r in pack_examples(named, tokenizer=WORDS).collect()} == {"a", None}


def test_long_texts(spark, plain):
    """A text of 60,000 words, one of 200,000 letters, and one copied many times."""
    rng = random.Random(12)
    many = prose(rng, 60_000, 20_000)
    rows = [(0, many), (1, "z" * 200_000), (2, "1" * 50_000), (3, "\n" * 30_000), *[(i, "the same text again") for i in range(4, 600)]]
    docs = spark.createDataFrame([(*r, "en", f"s{r[0] % 5}") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in align_tokens(docs, **FILES).collect()}
    a, _, b, _ = plain(many)
    assert (got[0].n_a, got[0].n_b) == (len(a), len(b)) and len(got) == len(rows)
    packed = pack_examples(docs, tokenizer=WORDS, digest=True)
    assert packed.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in packed.dropDuplicates(["doc_id"]).collect())
    assert source_divergence(docs).filter("part = 'term' and item = 'same'").count() <= 5


def test_ragged():
    assert tokens.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert tokens.sums(np.array([1, 2, 3]), np.array([0, 0, 2, 3])).tolist() == [0, 3, 3]
    number, edge, distinct = tokens.units([b" a b", b"", b" a\nb"])
    assert [distinct[i] for i in number] == [b" a", b" b", b" a", b"\nb"] and edge.tolist() == [0, 2, 2, 4]
    assert pa.array(distinct).type == pa.binary()
