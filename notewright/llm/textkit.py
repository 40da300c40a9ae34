"""Vectorised tokenising and hashing of Arrow text batches (numpy; no per-word Python)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; cut at white space, so that words stay whole.
CHUNK = 1 << 20
#: Bytes of documents gathered before one vectorised call.
GATHER = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=_U) | _U(1)
_P = _U(0x9E3779B97F4A7C15 | 3)
_Q = _U(0xD1342543DE82EF95 | 3)
_R = _U(0xA24BAED4963EE407 | 3)


def _powers(base: np.uint64, n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i < n."""
    have = cache.get(int(base))
    if have is None or len(have[0]) < n:
        inverse = _U(pow(int(base), -1, 2**64))
        size = max(n, 1 << 16)
        have = []
        for b in (base, inverse):
            p = np.full(size, b, _U)
            p[0] = 1
            have.append(np.multiply.accumulate(p))
        cache[int(base)] = have = tuple(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _hash_piece(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one piece."""
    word = ~_SPACE[piece]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers(_P, len(piece) + 1)
    total = np.zeros(len(piece) + 1, _U)
    np.cumsum(_BYTE[piece] * power[: len(piece)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return start, end, mix(h ^ ((end - start).astype(_U) * _R))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words (runs of bytes other than ASCII white space)."""
    buf = np.frombuffer(data, np.uint8)
    out, at = [], 0
    while at < len(buf):
        to = min(len(buf), at + CHUNK)
        if to < len(buf):
            gap = np.flatnonzero(_SPACE[buf[at:to]])
            while not len(gap) and to < len(buf):
                further = min(len(buf), to + CHUNK)
                gap = np.flatnonzero(_SPACE[buf[to:further]]) + (to - at)
                to = further
            to = at + int(gap[-1]) + 1 if len(gap) and to < len(buf) else to
        start, end, h = _hash_piece(buf[at:to])
        out.append((start + at, end + at, h))
        at = to
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Words:
    """The words of some documents: word hashes in order, and where each document's begin.

    bounds[i]:bounds[i+1] are the words of document i; start and end are byte
    positions in data, which holds the documents joined by one space."""

    def __init__(self, raw: list[bytes], lower: bool):
        self.data = b" ".join(raw)
        if lower:
            self.data = self.data.lower()
        self.start, self.end, self.hash = words_of(self.data)
        offset = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in raw], out=offset[1:])
        self.bounds = np.searchsorted(self.start, offset)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words, by the index of its first word, and whether it lies in one document."""
        return windows(self.hash, self.bounds, k)


def windows(h: np.ndarray, bounds: np.ndarray, k: int, base: np.uint64 = _Q) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    valid = np.zeros(n, bool)
    if n < k:
        return np.zeros(n, _U), valid
    power, inverse = _powers(base, n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(h * power[:n], out=total[1:])
    out = np.zeros(n, _U)
    out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * inverse[: n - k + 1])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    valid = left >= k
    return out, valid


def sequence_hash(h: np.ndarray) -> int:
    """128 bits that name a sequence of word hashes."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), "little")


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        return [x for c in column.chunks for x in raw_texts(c)]
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what is made of a batch's texts stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def gathered(raw: list[bytes], size: int = GATHER) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about size bytes each (one longer document is a range of its own)."""
    begin = total = 0
    for i, x in enumerate(raw):
        if total and total + len(x) > size:
            yield begin, i
            begin, total = i, 0
        total += len(x) + 1
    if begin < len(raw):
        yield begin, len(raw)


def shingle_sets(raw: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k-word shingles of each text, A-Z lower-cased.

    A text of fewer words is one shingle, one without words is empty."""
    out: list[np.ndarray] = []
    for a, b in gathered(raw):
        w = Words(raw[a:b], lower=True)
        h, _ = w.windows(k)
        for lo, hi in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            n = hi - lo
            if n >= k:
                out.append(np.unique(h[lo : hi - k + 1]))
            elif n:
                out.append(mix(windows(w.hash[lo:hi], np.array([0, n]), n)[0][:1] + _U(n)))
            else:
                out.append(np.zeros(0, _U))
    return out
