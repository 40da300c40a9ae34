"""Alignment of two tokenizers' tokens over whole texts, with corpus-wide counts of linked ids.

Method. Both tokenizers cut the same bytes; the union of both arrays of token ends gives elementary intervals. The
owner of an interval in either tokenisation is found by binary search of its end; each interval is one overlap of one A
token and one B token. An end that both share closes a group, the smallest run of tokens of both over the same bytes.
Over the corpus each id pair counts its overlaps. ``group_products`` expands groups into all their A-B pairs.

Scale. Each text is read and tokenised once, by distinct units (see tokens.py), and units always end a group. A block of
about BLOCK bytes of text sends one row for each distinct id pair, not for each overlap; counts are summed by pair and
come back to the block by the same rows. The most frequent pair is in each block once. The highest count of a B id is
broadcast: one row for each id of the vocabulary. Texts and token sequences are not shuffled; a document travels once,
as the sorted unit numbers of its block. A worker holds the units of a block, and of earlier ones up to KEPT.

Edge cases. Texts that are null, empty, or of which either tokenizer changes a byte have no tokens: zeros, and the empty
string for groups. Special tokens' strings are plain text. Rows that repeat an id are rows of their own; a text of any length
is taken whole, CHUNK bytes at a time. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textkit import gathered, parts, raw_texts
from .tokens import Kept, byte_of_letter, flattened, numbered, ragged, sums, union

#: Bytes of text in a block.
BLOCK = 8 << 20
_FACTS = ("n_a", "n_b", "n_groups", "n_links")


class Pair:
    """Two tokenizers over one text: a byte-level one (tokenizers) and a piece model (sentencepiece) that adds a space in front."""

    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        letter = byte_of_letter()
        entry = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t in entry]
        self.n_b = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.n_b)))]
        self.len_a, self.len_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        if any("▁" in p.lstrip("▁") or "\n" in p for p in map(self.b.id_to_piece, range(self.n_b))):
            raise ValueError("a piece holds a space or a line end behind another character: texts can't be cut there")
        self.space = self.b.piece_to_id("▁")
        # what stands before the end of a token: further tokens of the side, or the other side, or the next group
        self.shown = [s for i in range(len(entry)) for s in (b"%d," % i, b"%d|" % i)] + [s for i in range(self.n_b) for s in (b"%d," % i, b"%d;" % i)]
        self.kept = Kept(self.made)

    def ids(self, new: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Ids of both of units that begin with white space, each as one array and lengths, and whether both give the unit's bytes (else there are no ids)."""
        text = [u.decode() for u in new]
        a = [e.ids for e in self.a.encode_batch_fast(text, add_special_tokens=False)]
        b = self.b.encode([t[1:] if t[0] == " " else t for t in text], num_threads=1)
        # the model puts a space in front, which only a unit with a line end there lacks
        b = [ids if t[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for t, ids in zip(text, b, strict=True)]
        ok, size = np.ones(len(new), bool), np.fromiter(map(len, new), np.int64, len(new))
        flat = [flattened(a), flattened(b)]
        for (x, n), given, length in zip(flat, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b), strict=True):
            ok &= sums(length[x], np.append(0, np.cumsum(n))) == size
            if ok.all() and b"".join(map(given.__getitem__, x.tolist())) != b"".join(new):
                ok[:] = False
        if not ok.all():  # look at each
            for i, u in enumerate(new):
                ok[i] = b"".join(map(self.bytes_a.__getitem__, a[i])) == u == b"".join(map(self.bytes_b.__getitem__, b[i]))
            flat = [flattened([ids if good else [] for ids, good in zip(side, ok.tolist(), strict=True)]) for side in (a, b)]
        return *flat, ok

    def made(self, new: list[bytes]):
        (a, n_a), (b, n_b), ok = self.ids(new)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = union(end_a, end_b)
        own_a, own_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = (end_a[own_a] == ends) & (end_b[own_b] == ends)
        closed = ends[both]
        unit_end = np.cumsum(np.where(ok, [len(u) for u in new], 0))
        of = np.searchsorted(unit_end, ends)
        counted = lambda x: np.bincount(x, minlength=len(new)).astype(np.int64)
        # tokens of both in order of groups, A's first
        group_a, group_b = np.searchsorted(closed, end_a), np.searchsorted(closed, end_b)
        order = np.zeros(len(a) + len(b), np.int64)
        ends_group = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + ends_group(group_a)
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * len(self.bytes_a) + 2 * b + ends_group(group_b)
        items, edge = list(map(self.shown.__getitem__, order.tolist())), np.append(0, np.cumsum(n_a + n_b)).tolist()
        shown = np.empty(len(new), object)
        shown[:] = [b"".join(items[x:y])[:-1] for x, y in zip(edge, edge[1:], strict=False)]
        links = counted(of)
        return {"ok": ok, "n_a": n_a, "n_b": n_b, "n_groups": counted(of[both]), "n_links": links, "shown": shown}, {"links": (a[own_a] * self.n_b + b[own_b], links)}


@functools.lru_cache(maxsize=2)
def pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


class _Block:
    """Documents of one block, by numbers of units that the pair keeps."""

    def __init__(self, both: Pair):
        both.kept.trim()
        self.both, self.docs, self.size = both, [], 0

    def add(self, doc_id, number: np.ndarray) -> None:
        kept = self.both.kept
        if not len(number) or not kept.columns["ok"][number].all():
            number = number[:0]
        facts = [int(kept.columns[k][number].sum()) if len(number) else 0 for k in _FACTS]
        sha = hashlib.sha256()
        for i in range(0, len(number), 1 << 20):
            sha.update(b";" * (i > 0) + b";".join(kept.columns["shown"][number[i : i + (1 << 20)]].tolist()))
        self.docs.append((doc_id, facts, sha.hexdigest() if len(number) else "", np.sort(number)))

    def rows(self, blk: int, kind: pa.DataType) -> pa.RecordBatch:
        """A row for each document, with the differences of its sorted unit numbers, and one for the block, with what links they have."""
        kept = self.both.kept
        number = np.concatenate([d[3] for d in self.docs])
        own, index, n = np.unique(number, return_inverse=True, return_counts=True)
        at = np.append(0, np.cumsum([len(d[3]) for d in self.docs]))
        deltas = np.diff(index, prepend=0)
        deltas[at[:-1][at[:-1] < len(index)]] = index[at[:-1][at[:-1] < len(index)]]
        codes, links, length = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = codes
        if len(own):
            length = kept.length["links"][own]
            codes, links = np.unique(kept.flat["links"][ragged(kept.start["links"][own], length)], return_inverse=True)
            counts = np.bincount(links, weights=np.repeat(n, length)).astype(np.int64)
        none = [None] * len(self.docs)
        of = lambda x, t: pa.ListArray.from_arrays(pa.array([0] * (len(none) + 1) + [len(x)], pa.int32()), pa.array(x, t))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([blk] * (len(self.docs) + 1), pa.int64()), pa.array([False] * len(self.docs) + [True]), pa.array([*[d[0] for d in self.docs], None], kind),
                *[pa.array([*[d[1][i] for d in self.docs], None], pa.int64()) for i in range(len(_FACTS))], pa.array([*[d[2] for d in self.docs], None], pa.string()),
                pa.ListArray.from_arrays(pa.array(np.append(at, at[-1]), pa.int32()), pa.array(deltas, pa.int32())), of(codes, pa.int64()), of(counts, pa.int64()), of(links, pa.int32()), of(length, pa.int32()),
            ],
            names=["blk", "whole", "doc_id", *_FACTS, "groups_sha256", "units", "codes", "counts", "links", "lengths"],
        )


def _aligned(byte_level: str, pieces: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task, made = pair(byte_level, pieces), TaskContext.get().partitionId(), 0
        now = _Block(both)
        for batch in parts(batches):
            raw, kind = raw_texts(batch.column(1)), batch.schema.field(0).type
            ids = batch.column(0).to_pylist()
            for a, b in gathered(raw):
                for i, number in enumerate(numbered(both.kept, [b" " + x if x else x for x in raw[a:b]]), a):
                    now.add(ids[i], number)
                    now.size += len(raw[i])
                if now.size >= block:
                    yield now.rows(task << 32 | made, kind)
                    made += 1
                    now = _Block(both)
        if now.docs:
            yield now.rows(task << 32 | made, kind)

    return run


def _counted(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a block with sums of the counts and marks of its pairs, which come in any order."""
    is_block = np.asarray(rows["whole"])
    block, docs = rows.filter(pa.array(is_block)), rows.filter(pa.array(~is_block))
    order = np.argsort(np.asarray(answers["code"]), kind="stable")
    links, length = (block[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("links", "lengths"))
    edge = np.append(0, np.cumsum(length))
    units_ = docs["units"].combine_chunks()
    n = np.diff(units_.offsets.to_numpy()).astype(np.int64) if len(units_) else np.zeros(0, np.int64)
    flat = units_.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.append(0, np.cumsum(n))
    total = np.append(0, np.cumsum(flat))
    number = total[1:] - np.repeat(total[bounds[:-1]], n)
    out = {"doc_id": docs["doc_id"]} | {k: docs[k] for k in _FACTS}
    for name, column in (("n_best", "best"), ("count_sum", "n")):
        value = sums(np.asarray(answers[column]).astype(np.int64)[order][links], edge)
        out[name] = pa.array(sums(value[number], bounds))
    return pa.table(out | {"groups_sha256": docs["groups_sha256"]})


def align_tokens(docs: DataFrame, *, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose id pair is the most frequent of its B
    id), count_sum (of the pairs' corpus-wide counts over links) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.mapInArrow(
        _aligned(byte_level, pieces, block),
        f"blk long, whole boolean, doc_id {kind}, {', '.join(f'{k} long' for k in _FACTS)}, groups_sha256 string, units array<int>, codes array<long>, counts array<long>, links array<int>, lengths array<int>",
    )
    made = materialise(made, "aligned")
    asked = made.filter("whole").select("blk", F.explode(F.arrays_zip("codes", "counts")).alias("x")).select("blk", F.col("x.codes").alias("code"), F.col("x.counts").alias("n"))
    counts = asked.groupBy("code").agg(F.sum("n").alias("n")).withColumn("b", b_of(F.col("code"), pieces))
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(highest), "b").select("code", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    answers = asked.select(F.col("blk").alias("of"), "code").join(counts, "code")
    rows = made.drop("codes", "counts")
    return rows.groupBy("blk").cogroup(answers.groupBy("of")).applyInArrow(_counted, f"doc_id {kind}, {', '.join(f'{k} long' for k in _FACTS)}, n_best long, count_sum long, groups_sha256 string")


def b_of(code: Column, pieces: str) -> Column:
    """The B id of a pair's code."""
    return code % _pieces_of(pieces)


@functools.lru_cache(maxsize=2)
def _pieces_of(pieces: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces).get_piece_size()


def token_groups(docs: DataFrame, *, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: doc_id and groups, an array of (a, b), each an array of ids, in order (none without tokens)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_level, pieces)
        for batch in parts(batches):
            out = []
            for raw in raw_texts(batch.column(1)):
                both.kept.trim()
                number, groups = numbered(both.kept, [b" " + raw if raw else raw])[0], []
                if len(number) and both.kept.columns["ok"][number].all():
                    for shown in both.kept.columns["shown"][number].tolist():
                        groups += [dict(zip("ab", ([int(i) for i in side.split(b",")] for side in g.split(b"|")), strict=True)) for g in shown.split(b";")]
                out.append(groups)
            side = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("a", side), ("b", side)])))], names=["doc_id", "groups"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>")


def group_products(groups: DataFrame) -> DataFrame:
    """Counts of id pairs where a group stands for all pairs of its A and B tokens: a, b, n. groups: as token_groups() gives."""
    one = groups.select(F.explode("groups").alias("g")).select(F.explode("g.a").alias("a"), F.col("g.b").alias("bs"))
    return one.select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
