"""Substring dedup by difference-cover anchors.

Method. D is a difference cover modulo V: for any two positions i and j there is a
shift d < V with (i + d) mod V and (j + d) mod V both in D. Two equal runs of at
least V - 1 + W words therefore share an anchor, W words hashed at a cover
position in both. Only anchors are hashed at first (|D| / V of all positions).
Where an anchor recurs, the match is extended: the full windows that hold it are
hashed and compared, and a window seen twice removes its words.

Scale. Anchors travel as (hash, block) with a count per task and block, windows
likewise, so a passage that every document holds sends a row per block and task
at most. Whole copies are found by one digest a document; of them one hashes its
windows. Blocks of documents have a fixed size in bytes.

Windows and whole texts are compared by 93 bits of two hashes of their words: of n
candidate windows about n * n / 2**94 pairs would agree by chance, one in 20,000 corpora of
10**12. Anchors, which only propose, have 63.

Edge cases. Null or wordless text: no words, nothing removed, the hash of the empty
string. Texts shorter than a window keep all. Rows that repeat a doc_id count as
documents of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_of, text_bytes
from .textkit import _U, Words, gathered, raw_texts, sequence_hash, signed, windows

#: Perfect difference sets, by their period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Bytes of text in a block.
BLOCK_BYTES = 8_000_000
#: Further bits of a key.
MORE = 2**30 - 1
_S = _U(0x8CB92BA72F3D8DD7)


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length for a window: the longest period that leaves anchors two fifths of it."""
    fit = [v for v in COVERS if window - v + 1 >= max(2, window * 2 // 5)] or [1]
    v = max(fit)
    return v, COVERS.get(v, (0,)), window - v + 1


def _position(w: Words) -> np.ndarray:
    """Index of each word in its document."""
    return np.arange(len(w.hash)) - np.repeat(w.bounds[:-1], np.diff(w.bounds))


def _tallied(*keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the keys and their summed weights."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, np.zeros(0, np.int64)
    new = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
    at = np.flatnonzero(new)
    total = np.add.reduceat(weight[order] if weight is not None else np.ones(len(order), np.int64), at)
    return [k[at] for k in keys], total


def _digest_of(words: np.ndarray) -> tuple[int, int]:
    """A whole word sequence as a key and its further bits; whole keys are odd, anchors and windows even."""
    d = sequence_hash(words)
    return ((d & (2**64 - 1)) - 2**63) | 1, (d >> 64) & MORE


def _packed(block: np.ndarray, n: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Further bits of a key, block and count (2 stands for more) in one long."""
    return (more.astype(np.int64) << 33) | (block.astype(np.int64) << 2) | np.minimum(n, 2)


def _anchors(window: int):
    v, cover, length = cover_for(window)
    on = np.zeros(v, bool)
    on[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, block = raw_texts(batch.column(0)), np.asarray(batch.column(1))
            for a, b in gathered(raw, 8 << 20):
                w = Words(raw[a:b], lower=False)
                of = np.repeat(block[a:b], np.diff(w.bounds))
                h, valid = w.windows(length)
                valid &= on[_position(w) % v]
                keys, more, blocks = [signed(h[valid]) & ~1], [np.zeros(int(valid.sum()), np.int64)], [of[valid]]
                for i, lo, hi in zip(range(a, b), w.bounds[:-1], w.bounds[1:], strict=True):
                    if hi - lo >= window:
                        for kept, x in zip((keys, more), _digest_of(w.hash[lo:hi]), strict=True):
                            kept.append(np.array([x], np.int64))
                        blocks.append(block[i : i + 1])
                (key, extra, blk), n = _tallied(*(np.concatenate(x) for x in (keys, more, blocks)))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(_packed(blk, n, extra))], names=["key", "at"])

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, at): those whose key, with its further bits, occurs more than once; lead marks a key's first row.

    Holds the rows of one key at most beyond a batch, and those are one for each task and block."""
    rest: list = []

    def done(k, at):
        if not len(k):
            return None
        more = at >> 33
        first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (more[1:] != more[:-1]))))
        total = np.add.reduceat(at & 3, first)
        lead = np.zeros(len(k), bool)
        lead[first] = True
        keep = np.repeat(total > 1, np.diff(np.append(first, len(k))))
        blk = ((at[keep] >> 2) & 0x7FFFFFFF).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(blk), pa.array(k[keep]), pa.array(more[keep].astype(np.int32)), pa.array(lead[keep])], names=["blk", "key", "more", "lead"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        if rest[0][0][0] == rest[-1][0][-1]:
            continue
        k, at = (np.concatenate(x) for x in zip(*rest, strict=True))
        cut = int(np.searchsorted(k, k[-1]))
        yield done(k[:cut], at[:cut])
        rest = [(k[cut:], at[cut:])]
    if rest:
        yield done(*(np.concatenate(x) for x in zip(*rest, strict=True)))


def _whole_copies(w: Words, window: int, copies: set[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """First and last word and digest of each document that is a whole copy."""
    for lo, hi in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if copies and hi - lo >= window:
            d = _digest_of(w.hash[lo:hi])
            if d in copies:
                yield lo, hi, d


def _further(w: Words, window: int) -> np.ndarray:
    """Further bits of each window, by another hash of its words."""
    return (windows(w.hash, w.bounds, window, _S)[0] & _U(MORE)).astype(np.int64)


def _split(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, further bits, and which are whole texts and which lead."""
    return (*(np.asarray(found[c]) for c in ("key", "more")), (np.asarray(found["key"]) & 1) == 1, np.asarray(found["lead"]))


def _candidate_windows(window: int):
    v, cover, length = cover_for(window)
    on = np.zeros(v, bool)
    on[list(cover)] = True

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        keys, more, whole, lead = _split(found)
        anchors = np.unique(keys[~whole])
        copies = set(zip(keys[whole].tolist(), more[whole].tolist(), strict=True))
        mine = set(zip(keys[whole & lead].tolist(), more[whole & lead].tolist(), strict=True))
        raw = raw_texts(docs["text"])
        once = np.array(sorted(copies), np.int64).reshape(-1, 2)
        k_out, m_out, n_out = [once[:, 0]], [once[:, 1]], [np.full(len(once), 2)]
        for a, b in gathered(raw):
            w = Words(raw[a:b], lower=False)
            n = len(w.hash)
            h, valid = w.windows(length)
            at = np.flatnonzero(valid & on[_position(w) % v])
            at = at[_within(signed(h[at]) & ~1, anchors)]
            mark = np.zeros(n + 1, np.int64)
            np.add.at(mark, np.maximum(at - (v - 1), 0), 1)
            np.add.at(mark, at + 1, -1)
            full, valid = w.windows(window)
            want = valid & (np.cumsum(mark[:n]) > 0)
            weight = np.ones(n, np.int64)
            for lo, hi, d in _whole_copies(w, window, copies):
                want[lo:hi] = valid[lo:hi] & (d in mine)
                weight[lo:hi] = 2
                mine.discard(d)
            (k, m), total = _tallied(signed(full[want]) & ~1, _further(w, window)[want], weight=weight[want])
            k_out.append(k)
            m_out.append(m)
            n_out.append(total)
        k, m, n = (np.concatenate(x) for x in (k_out, m_out, n_out))
        return pa.table({"key": k, "at": _packed(np.full(len(k), key[0] or 0), n, m)})

    return run


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _both_within(x: np.ndarray, more: np.ndarray, keys: np.ndarray, further: np.ndarray) -> np.ndarray:
    """Which pairs (x, more) are among the pairs (keys, further), which are in order."""
    lo, hi = np.searchsorted(keys, x, side="left"), np.searchsorted(keys, x, side="right")
    out = np.zeros(len(x), bool)
    # a key has one row but for chance
    for i in range(int((hi - lo).max(initial=0))):
        some = np.flatnonzero(lo + i < hi)
        out[some] |= further[lo[some] + i] == more[some]
    return out


def _removal(window: int):
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        keys, more, whole, _ = _split(found)
        copies = set(zip(keys[whole].tolist(), more[whole].tolist(), strict=True))
        (known, further), _ = _tallied(keys[~whole], more[~whole])
        raw = raw_texts(docs["text"])
        n_words, n_removed, kept, spans = [], [], [], []
        for a, b in gathered(raw):
            w = Words(raw[a:b], lower=False)
            n = len(w.hash)
            full, valid = w.windows(window)
            at = np.flatnonzero(valid)
            at = at[_both_within(signed(full[at]) & ~1, _further(w, window)[at], known, further)]
            mark = np.zeros(n + window + 1, np.int64)
            mark[at] += 1
            np.add.at(mark, at + window, -1)
            gone = np.cumsum(mark)[:n] > 0
            for lo, hi, _ in _whole_copies(w, window, copies):
                gone[lo:hi] = True
            for lo, hi in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
                keep = np.flatnonzero(~gone[lo:hi]) + lo
                if len(keep) == hi - lo and hi > lo:
                    text = b" ".join(w.data[w.start[lo] : w.end[hi - 1]].split())
                else:
                    s, e = w.start[keep].tolist(), w.end[keep].tolist()
                    text = b" ".join([w.data[x:y] for x, y in zip(s, e, strict=True)])
                n_words.append(hi - lo)
                n_removed.append(hi - lo - len(keep))
                kept.append(text)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[lo:hi], [False])).view(np.int8)))
                spans.append(edge.tolist())
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_text": pa.array([x.decode() for x in kept], pa.string()),
                "removed": pa.array(spans, pa.list_(pa.int64())),
            }
        )

    return run


def _digest(run):
    """The same with the kept text's sha256 in place of the text and spans."""

    def short(key, docs, found):
        t = run(key, docs, found)
        sha = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in t["kept_text"].to_pylist()], pa.string())
        return pa.table({"doc_id": t["doc_id"], "n_words": t["n_words"], "n_removed": t["n_removed"], "kept_sha256": sha})

    return short


def substring_dedup(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text and removed
    (word positions where removed runs begin and end, alternately); with digest,
    kept_sha256 in place of the last two."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = max(1, -(-text_bytes(docs, "text") // BLOCK_BYTES))
    dealt = docs.select("doc_id", "text", block_of(F.col("doc_id"), F.col("text"), blocks).alias("blk"))

    recurring = lambda rows: rows.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_recurring, "blk int, key long, more int, lead boolean")
    anchors = recurring(dealt.select("text", "blk").mapInArrow(_anchors(window), "key long, at long"))
    found = dealt.groupBy("blk").cogroup(anchors.groupBy("blk")).applyInArrow(_candidate_windows(window), "key long, at long")
    gone = recurring(found)
    run, last = _removal(window), "kept_text string, removed array<long>"
    if digest:
        run, last = _digest(run), "kept_sha256 string"
    return dealt.groupBy("blk").cogroup(gone.groupBy("blk")).applyInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, {last}")
