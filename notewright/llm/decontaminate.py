"""Benchmark decontamination by SimHash over windows of an item's size.

Method. Every window of a document as long as an item, in words, has a 64-bit
SimHash of its word shingles, weighted by how often they occur. A multi-index of
eight blocks finds the items within RADIUS: fingerprints that differ in at most RADIUS
bits differ in at most BLOCK_RADIUS in one block. Candidates are verified by
exact weighted similarity, the sum of the lesser over that of the greater counts. Windows
that hold no shingle of an item of their size have similarity 0 and are not hashed, which loses nothing.
At similarity 0.8 fingerprints differ in about 10 bits, so RADIUS is four standard deviations beyond.

Scale. Documents are read in one pass without a shuffle, in parts of a batch; of a long
text windows are hashed near hits only, piece by piece. Items are gathered and sent
to executors in parts of at most ITEM_BYTES, however many there are; each part is a
pass of its own.

Edge cases. Null or wordless texts hold nothing; null or wordless items match nothing.
A text shorter than an item is compared whole. An item of fewer words than a
shingle is one shingle. Equal items are all reported. Rows that repeat a doc_id with
another text are told apart by the text's hash. Other columns pass through; names that begin with nw_ are refused.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import refuse
from .textkit import _U, Words, gathered, raw_texts, windows
from .textkit import parts as in_parts

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, BLOCK_RADIUS = 22, 8, 2
ITEM_BYTES = 32_000_000
_BITS = np.arange(64, dtype=_U)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: The bytes that differ from a byte in BLOCK_RADIUS bits at most.
_NEAR = np.array([np.flatnonzero(_ONES[np.arange(256) ^ v] <= BLOCK_RADIUS) for v in range(256)])
#: Pairs of windows and items of one length that are looked at together.
PAIRS = 2_000_000


def _signs(h: np.ndarray) -> np.ndarray:
    return (((h[:, None] >> _BITS) & _U(1)).astype(np.int32) << 1) - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(_U) << _BITS).sum(axis=1, dtype=_U)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ONES[(a ^ b).view(np.uint8).reshape(-1, 8)].sum(axis=1)


class Items:
    """Items of a benchmark, in arrays: shingle counts, fingerprints, the lengths that hold a shingle, and a multi-index for each length.

    Some 40 bytes a word: a part of ITEM_BYTES takes about 250 MB in a worker."""

    def __init__(self, ids: list[int], texts: list[bytes], shingle: int = SHINGLE):
        self.shingle = shingle
        w = Words(texts, lower=True)
        keep = [(i, lo, hi) for i, lo, hi in zip(ids, w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True) if hi > lo and i is not None]
        self.ids = [i for i, _, _ in keep]
        self.length = np.array([hi - lo for _, lo, hi in keep], np.int64)
        counts = [np.unique(_shingles(w.hash[lo:hi], min(shingle, hi - lo)), return_counts=True) for _, lo, hi in keep]
        self.at = np.cumsum([0, *[len(k) for k, _ in counts]])
        self.keys = np.concatenate([np.zeros(0, _U), *[k for k, _ in counts]])
        self.n = np.concatenate([np.zeros(0, np.int64), *[n for _, n in counts]])
        self.finger = np.array([_fingerprints((_signs(k) * n[:, None]).sum(axis=0)[None])[0] for k, n in counts], _U)
        self.by_length = {int(n): np.flatnonzero(self.length == n) for n in np.unique(self.length)}
        # by size of shingle: shingles and the lengths of the items that hold them, in order
        size = np.repeat(self.length, np.diff(self.at))
        self.owner: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(np.minimum(self.length, shingle)).tolist():
            mine = np.minimum(size, shingle) == k
            both = np.unique(np.rec.fromarrays([self.keys[mine], size[mine]], names="key,length"))
            self.owner[k] = np.ascontiguousarray(both["key"]), np.ascontiguousarray(both["length"])
        # by length and block: members in order of the block's byte, and where each byte begins
        self.index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, members in self.by_length.items():
            byte = self.finger[members].view(np.uint8).reshape(-1, BLOCKS)
            order = [np.argsort(byte[:, b], kind="stable") for b in range(BLOCKS)]
            self.index[n] = [(o, np.searchsorted(byte[o, b], np.arange(257))) for b, o in enumerate(order)]

    def lengths_of(self, k: int, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the shingles h at positions at: (position, length) for each length whose items hold one."""
        keys, lengths = self.owner[k]
        lo, hi = np.searchsorted(keys, h[at], side="left"), np.searchsorted(keys, h[at], side="right")
        row, entry = _ranges(lo, hi)
        return at[row], lengths[entry]

    def candidates(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) with fingerprints within RADIUS: those that differ in BLOCK_RADIUS bits at most in some block, then checked."""
        members = self.by_length[length]
        byte, found = prints.view(np.uint8).reshape(-1, BLOCKS), []
        for b, (order, start) in enumerate(self.index[length]):
            near = _NEAR[byte[:, b]]
            row, entry = _ranges(start[near].ravel(), start[near + 1].ravel())
            found.append((row // near.shape[1]) * len(members) + order[entry])
        w, m = np.divmod(np.unique(np.concatenate(found)), len(members))
        close = _distance(prints[w], self.finger[members[m]]) <= RADIUS
        return w[close], members[m[close]]

    def similarity(self, item: int, h: np.ndarray) -> float:
        here = slice(self.at[item], self.at[item + 1])
        keys, n = self.keys[here], self.n[here]
        mine, m = np.unique(h, return_counts=True)
        at = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
        both = int(np.minimum(n, np.where(mine[at] == keys, m[at], 0)).sum())
        return both / (int(n.sum()) + int(m.sum()) - both)

    def matches(self, h: np.ndarray, hits: dict[int, np.ndarray], least: float) -> list[dict]:
        """Best window of each item that passes. h: word hashes of a document; hits: by item length, where its shingles occur."""
        best: dict[int, tuple[float, int, int]] = {}
        n = len(h)
        for length, at in hits.items():
            k, size = min(self.shingle, length), min(length, n)
            # a window that holds no shingle of an item of its length has similarity 0 and is not hashed
            starts = np.unique(np.clip((at[:, None] + np.arange(k - size, 1)).ravel(), 0, n - size))
            piece = max(64, PAIRS // len(self.by_length[length]))
            far = np.flatnonzero(np.diff(starts) > size) + 1
            cuts = sorted({0, len(starts), *far.tolist(), *range(0, len(starts), piece)})
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine = starts[a:b]
                s = _shingles(h[mine[0] : mine[-1] + size], k)
                total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(s), axis=0, dtype=np.int32)])
                off = mine - mine[0]
                prints = _fingerprints(total[off + size - k + 1] - total[off])
                for w, m in zip(*(x.tolist() for x in self.candidates(length, prints)), strict=True):
                    sim = self.similarity(m, s[off[w] : off[w] + size - k + 1])
                    if sim >= least and sim > best.get(m, (0,))[0]:
                        best[m] = sim, int(mine[w]), int(mine[w] + size)
        return [{"item_id": self.ids[m], "similarity": v[0], "start": v[1], "end": v[2]} for m, v in sorted(best.items(), key=lambda x: self.ids[x[0]])]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of each range [lo, hi), and the range it is of."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    return windows(h, np.array([0, len(h)]), k)[0][: len(h) - k + 1]


MATCH = "array<struct<item_id:long,similarity:double,start:int,end:int>>"
_MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(items, least: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Items = items.value
        for batch in in_parts(batches):
            raw = raw_texts(batch.column(text_at))
            out: list[list] = [[] for _ in raw]
            for a, b in gathered(raw):
                w = Words(raw[a:b], lower=True)
                hits: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
                for k, (keys, _) in ix.owner.items():
                    h, valid = w.windows(k)
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    here, lengths = ix.lengths_of(k, h, np.flatnonzero(valid & (keys[at] == h)))
                    doc = np.searchsorted(w.bounds, here, side="right") - 1
                    for p, d, length in zip(here.tolist(), doc.tolist(), lengths.tolist(), strict=True):
                        hits[d][length].append(p - int(w.bounds[d]))
                for d, by in hits.items():
                    out[a + d] = ix.matches(w.hash[w.bounds[d] : w.bounds[d + 1]], {n: np.array(p) for n, p in by.items()}, least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _MATCH_ARROW)], names=[*batch.schema.names, "nw_matches"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """docs with nw_matches: items they hold, the similarity and the words of the best window."""
    refuse(docs)
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-size // ITEM_BYTES) or 1
    schema = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def one(df: DataFrame, part: int) -> DataFrame:
        mine = items.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).orderBy("i").toArrow()
        sent = spark.sparkContext.broadcast(Items(mine["i"].to_pylist(), raw_texts(mine["t"]), shingle))
        return df.mapInArrow(_found(sent, similarity, df.columns.index(text_col)), f"{schema(df)}, nw_matches {MATCH}")

    if parts == 1:
        return one(docs, 0)
    keyed = docs.select(F.col(id_col).alias("nw_id"), F.xxhash64(text_col).alias("nw_hash"), F.col(text_col))
    every = None
    for part in range(parts):
        got = one(keyed, part).filter("size(nw_matches) > 0").drop(text_col)
        every = got if every is None else every.union(got)
    by = every.distinct().groupBy("nw_id", "nw_hash").agg(F.array_sort(F.flatten(F.collect_list("nw_matches"))).alias("nw_matches"))
    joined = docs.join(by, F.col(id_col).eqNullSafe(F.col("nw_id")) & (F.xxhash64(text_col) == F.col("nw_hash")), "left")
    return joined.select(*[docs[c] for c in docs.columns], F.coalesce("nw_matches", F.array().cast(MATCH)).alias("nw_matches"))
