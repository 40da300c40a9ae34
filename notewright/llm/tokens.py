"""Tokenising by distinct pieces of text.

A text is cut before every single space or line end between two characters that are surely not white space. The
tokenizers in use never join such a cut: byte-level and word patterns end a token there, and no piece of the
piece model holds a space behind another character. So the distinct units of a batch are tokenised once each,
whatever their number, and what was made of a unit is kept for the worker's next batches.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of one text that are cut into units at a time.
CHUNK = 4 << 20
#: Units that a worker keeps from one block to the next.
KEPT = 200_000
#: New units that are tokenised at a time.
AT_ONCE = 20_000
# Spark runs a task on each core; a tokenizer's own threads would only wait for each other
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_CUT = np.zeros(256, bool)
_CUT[[0x0A, 0x20]] = True
#: Printable ASCII, and first bytes of two-byte characters, none of which is white space from 0xC3 on.
_NEXT = np.zeros(256, bool)
_NEXT[0x21:0x7F] = _NEXT[0xC3:0xE0] = True
_LAST = np.zeros(256, bool)
_LAST[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def cuts(buf: np.ndarray) -> np.ndarray:
    """Positions where a unit begins, but for 0."""
    at = np.flatnonzero(_CUT[buf])
    at = at[(at > 0) & (at + 1 < len(buf))]
    before, before2 = buf[at - 1], buf[np.maximum(at - 2, 0)]
    return at[(_LAST[before] | (_LEAD[before2] & (before >= 0x80) & (at > 1))) & _NEXT[buf[at + 1]]]


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """data in parts of about size bytes, cut where a unit begins; longer where there is no such place."""
    at = 0
    while len(data) - at > size:
        span = size
        while True:
            found = cuts(np.frombuffer(data, np.uint8, min(span, len(data) - at), at))
            if len(found) or at + span >= len(data):
                break
            span *= 2
        if not len(found):
            break
        yield data[at : at + int(found[-1])]
        at += int(found[-1])
    yield data[at:] if at else data


#: 1 for marks of punctuation, 2 for ASCII letters, more than their sum for all else.
_KIND = np.full(256, 4, np.uint8)
_KIND[list(b'.,;:!?()"')] = 1
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 2


def letter_cuts(buf: np.ndarray) -> np.ndarray:
    """Positions where a unit may begin if words are letters only: those of cuts(), and between an ASCII letter and a mark of punctuation."""
    kind = _KIND[buf]
    return np.concatenate((cuts(buf), np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1))


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def units(parts: list[bytes], cut: Callable[[np.ndarray], np.ndarray] = cuts) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The units of some texts in order, as numbers of distinct units; where each text's begin; the distinct units.

    Each text begins a unit; an empty one has none."""
    data = b"".join(parts)
    edge = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=edge[1:])
    if not data:
        return np.zeros(0, np.int32), np.zeros(len(parts) + 1, np.int64), []
    begins = np.zeros(len(data) + 1, bool)
    begins[cut(np.frombuffer(data, np.uint8))] = True
    begins[edge] = True
    start = np.flatnonzero(begins[:-1])
    offsets = np.append(start, len(data)).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return np.asarray(array.indices), np.searchsorted(start, edge), array.dictionary.to_pylist()


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] ... start[i] + length[i] - 1 of all i, in order."""
    total = np.cumsum(length)
    n = int(total[-1]) if len(total) else 0
    return np.arange(n) + np.repeat(start - (total - length), length)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Kept:
    """What make() gave for each distinct unit so far.

    make(units) -> (columns, lists): arrays with an entry a unit, and ragged arrays as (flat, lengths)."""

    def __init__(self, make: Callable[[list[bytes]], tuple[dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]]):
        self.make, self.at = make, {}
        self.columns, self.flat, self.length, self.start = {}, {}, {}, {}

    def trim(self, most: int | None = None) -> None:
        """Forget all units if they are more than KEPT (or as given); numbers given before are void then."""
        if len(self.at) > (KEPT if most is None else most):
            self.__init__(self.make)

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        """Each unit's index in the arrays, to which new units are added."""
        new = [u for u in distinct if u not in self.at]
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            columns, lists = self.make(some)
            self.at.update(zip(some, range(len(self.at), len(self.at) + len(some)), strict=True))
            join = lambda old, x: x if old is None else np.concatenate((old, x))
            for k, x in columns.items():
                self.columns[k] = join(self.columns.get(k), x)
            for k, (x, n) in lists.items():
                self.flat[k] = join(self.flat.get(k), x)
                self.length[k] = join(self.length.get(k), n)
                self.start[k] = np.cumsum(self.length[k]) - self.length[k]
        return np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as one array and their lengths."""
    length = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(length.sum())), length


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.union1d of two arrays in order, by merging them."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


def numbered(kept: Kept, texts: list[bytes], cut: Callable[[np.ndarray], np.ndarray] = cuts) -> list[np.ndarray]:
    """Each text's units, in order, by their index in kept; a single text goes chunk by chunk."""

    def of(parts: list[bytes]) -> list[np.ndarray]:
        index, edge, distinct = units(parts, cut)
        number = kept.numbers(distinct)[index] if distinct else np.zeros(0, np.int64)
        return [number[x:y] for x, y in zip(edge, edge[1:], strict=False)]

    if len(texts) == 1:
        return [np.concatenate([of([part])[0] for part in chunks(texts[0])])]
    return of(texts)
