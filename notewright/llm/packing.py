"""Vector bin packing of examples into training sequences.

Method. An example needs tokens, one segment and loss-bearing tokens; a sequence has so much of each. The open sequence
takes, of the examples that fit what is left of it in every dimension, the one with the greatest dot product of its needs
and what is left, each dimension weighed by the mean need of the pool. If none fits whole, the one of the greatest product is cut: the piece
fills the sequence, the rest stays in the pool. Only the last sequence of a task can be short. It is cut into sequences
whose lengths are powers of two, which need no padding.

Scale. No shuffle: each task packs its own rows, pool by pool of about POOL ids, so memory doesn't grow with the
partition; what the last sequence of a pool holds goes back into the next. Texts are tokenised by distinct units (see tokens.py). A task
wastes nothing if its segments suffice; if a pool has so many tiny examples that a sequence is full of segments first,
that sequence is padded. sequence_id holds the partition in its high half: a task that runs again packs its rows again, and no piece of a
document lies in another task's sequence.

Edge cases. A null or empty text is its end id alone. A text of any length is taken whole. Rows that repeat an id are examples of their
own. A null prompt is empty. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import gathered, parts, raw_texts
from .tokens import Kept, byte_of_letter, flattened, letter_cuts, numbered, ragged

LENGTH, SEGMENTS, END = 2048, 1024, 1
#: Distinct words that a worker keeps.
WORDS = 500_000
#: Bytes of text that are tokenised together.
GATHERED = 6 << 20
#: Ids of the pool that examples are chosen from.
POOL = 1 << 20


#: Words of letters that the tokenizer only lower-cases: a-z and those of Latin-1.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PROBES = ("a", "Word", "words", "ÀÉß", "straße", "élan", "x" * 60, "øre", "Tt")


class Encoder:
    """Ids of whole texts by a tokenizer that never joins text over white space, nor letters and punctuation.

    The model itself is asked for a word of letters, which spares it the alignment of a text that has nothing to normalise; all else goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), Kept(self.made)
        self.model = self.tokenizer.model
        self.letter = str.maketrans({b: c for c, b in byte_of_letter().items()})
        if any(self.word(w.encode()) != self.tokenizer.encode(w, add_special_tokens=False).ids for w in _PROBES):
            self.word = lambda u: self.tokenizer.encode(u.decode(), add_special_tokens=False).ids

    def word(self, u: bytes) -> list[int]:
        u = u.removeprefix(b" ")
        text = u.decode().lower() if u.isascii() else u.decode().lower().encode().decode("latin-1").translate(self.letter)
        return [t.id for t in self.model.tokenize(text)]

    def made(self, new: list[bytes]):
        found = [self.word(u) if _WORD.fullmatch(u) else None for u in new]
        rest = iter(self.tokenizer.encode_batch_fast([u.decode() for u, ids in zip(new, found, strict=True) if ids is None], add_special_tokens=False))
        ids, n = flattened([next(rest).ids if ids is None else ids for ids in found])
        return {}, {"ids": (ids.astype(np.int32), n)}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        self.kept.trim(WORDS)
        # white space is dropped, whichever it is; ids of special tokens are those of their strings as they are written
        texts = [t.replace(b"\n", b" ") if b"<|" in t else t.lower().replace(b"\n", b" ") for t in texts]
        out = []
        for number in numbered(self.kept, texts, letter_cuts):
            if len(number):
                kept = self.kept
                out.append(kept.flat["ids"][ragged(kept.start["ids"][number], kept.length["ids"][number])])
            else:
                out.append(np.zeros(0, np.int32))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Packs examples, each an array of ids of which those from a position on bear loss.

    A piece is (example, start, length), an example (doc, ids, position of the first id that bears loss)."""

    def __init__(self, length: int, segments: int, loss: int):
        self.length, self.segments, self.loss = length, segments, loss
        self.sequence = self.waiting = 0
        self._clear()

    def _clear(self) -> None:
        self.index: dict[tuple[int, int], int] = {}
        self.pieces: list[list] = []
        self.need, self.number = np.zeros((64, 2)), np.zeros(64, np.int64)

    def _loss(self, example, start: int, n: int) -> int:
        return max(0, start + n - max(start, example[2]))

    def _within(self, piece, tokens: int, loss: int) -> int:
        """Length of the longest beginning of a piece that has at most so many tokens and loss-bearing ones."""
        example, start, n = piece
        return min(n, tokens, max(example[2] - start, 0) + loss)

    def put(self, piece) -> None:
        """A piece that waits; it fits an empty sequence."""
        example, start, n = piece
        need = (n, self._loss(example, start, n))
        k = self.index.setdefault(need, len(self.pieces))
        if k == len(self.pieces):
            self.pieces.append([])
            if k == len(self.number):
                self.need, self.number = np.concatenate((self.need, np.zeros_like(self.need))), np.concatenate((self.number, np.zeros_like(self.number)))
            self.need[k] = need
        self.pieces[k].append(piece)
        self.number[k] += 1
        self.waiting += n

    def _take(self, k: int):
        piece = self.pieces[k].pop()
        self.number[k] -= 1
        self.waiting -= piece[2]
        return piece

    def add(self, doc, ids: np.ndarray, loss_from: int) -> Iterator[tuple]:
        """An example; what fills whole sequences of its own is packed at once."""
        example, start = (doc, ids, loss_from), 0
        while start < len(ids):
            n = self._within((example, start, len(ids) - start), self.length, self.loss)
            if n == self.length:
                yield from self._closed([(example, start, n)])
            else:
                self.put((example, start, n))
            start += n

    def _closed(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for (doc, ids, _), start, n in pieces:
            yield doc, start, n, ids[start : start + n], len(ids), self.sequence, offset
            offset += n
        self.sequence += 1

    def _in_powers(self, pieces: list) -> Iterator[tuple]:
        """The pieces in sequences whose lengths are powers of two, the greatest first."""
        pieces, rest = pieces[::-1], sum(n for *_, n in pieces)
        while rest:
            size = room = 1 << (rest.bit_length() - 1)
            now = []
            while room:
                example, start, n = pieces.pop()
                if n > room:
                    pieces.append((example, start + room, n - room))
                    n = room
                now.append((example, start, n))
                room -= n
            yield from self._closed(now)
            rest -= size

    def pack(self, last: bool) -> Iterator[tuple]:
        """(doc, start, length, ids, tokens of the example, sequence, offset) of each piece packed; unless last, a short sequence's pieces wait on."""
        full = np.array([self.length, self.loss], float)
        total = np.maximum(self.number.sum(), 1)
        weight = (self.need * self.number[:, None]).sum(0) / total / full / full**2
        while self.waiting:
            now, left, segments, short = [], full.copy(), self.segments, False
            while left[0] and segments:
                k = len(self.pieces)
                need, there = self.need[:k], self.number[:k] > 0
                if not self.waiting:
                    short = True
                    break
                worth = need @ (weight * left)
                fits = there & (need[:, 0] <= left[0]) & (need[:, 1] <= left[1])
                if fits.any():
                    piece = self._take(int(np.argmax(np.where(fits, worth, -1.0))))
                else:
                    k = int(np.argmax(np.where(there, worth, -1.0)))
                    n = self._within(self.pieces[k][-1], int(left[0]), int(left[1]))
                    if not n:
                        break
                    example, start, whole = self._take(k)
                    piece = (example, start, n)
                    self.put((example, start + n, whole - n))
                now.append(piece)
                left -= (piece[2], self._loss(*piece))
                segments -= 1
            if not short:
                yield from self._closed(now)
            elif last:
                yield from self._in_powers(now)
            else:
                self._clear()
                for piece in now:
                    self.put(piece)
                return
        self._clear()


def _packed(tokenizer: str, length: int, segments: int, loss: int, pool: int, digest: bool, with_prompt: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first, packer = encoder(tokenizer), TaskContext.get().partitionId() << 32, Packer(length, segments, loss)
        end = np.array([END], np.int32)

        def made(rows, kind):
            doc, start, n, ids, total, sequence, offset = zip(*rows, strict=True) if rows else [()] * 7
            shown = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()) if digest else pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))
            longs = [pa.array(x, pa.int64()) for x in (start, n, total, [first + q for q in sequence], offset)]
            return pa.RecordBatch.from_arrays([pa.array(doc, kind), *longs, shown], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        kind = None
        for batch in parts(batches, 2000):
            kind, doc = batch.schema.field(0).type, batch.column(0).to_pylist()
            raw = raw_texts(batch.column(1))
            prompt = raw_texts(batch.column(2)) if with_prompt else []
            for a, b in gathered([x + y for x, y in zip(prompt, raw, strict=True)] if with_prompt else raw, GATHERED):
                rows = []
                for i, before, ids in zip(range(a, b), coder.encode(prompt[a:b]) if with_prompt else [end[:0]] * (b - a), coder.encode(raw[a:b]), strict=True):
                    rows += packer.add(doc[i], np.concatenate((before, ids, end)), len(before))
                if packer.waiting >= pool:
                    rows += packer.pack(False)
                if rows:
                    yield made(rows, kind)
        if packer.waiting:
            yield made(list(packer.pack(True)), kind)

    return run


def pack_examples(
    docs: DataFrame, *, tokenizer: str, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, pool: int = POOL, digest: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (with digest ids_crc32 in place of ids).

    A sequence holds at most length ids, segments pieces and loss (length, if not given) ids that bear loss. An example is its prompt, of which
    no id bears loss, its text and an end id."""
    if min(length, segments, length if loss is None else loss) < 1:
        raise ValueError("length, segments and loss must be positive")
    prompt = [F.col(prompt_col).alias("prompt")] if prompt_col is not None else []
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *prompt)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(
        _packed(tokenizer, length, segments, length if loss is None else loss, pool, digest, prompt_col is not None),
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids {'long' if digest else 'array<int>'}",
    )
    return out.withColumnRenamed("ids", "ids_crc32") if digest else out
