"""Language-model scores from a weighted backoff automaton.

Method. Texts are sequences of words (A-Z lower-cased) and one end. A state of the
automaton is the word before; its arcs are the pairs of words seen in training. A word
without an arc there falls back along the state's failure arc, which has a weight, to the
list of words, and from there along another to the spelling: a word that was never seen is
read byte by byte, from states that are the bytes before, which fall back likewise. One
left-to-right traversal carries the state and adds the logarithms.

    P(w | v) = (pairs(v, w) + prior(v) P(w)) / (n(v) + prior(v)), prior(v) = PRIOR (n(v) + 1) ** SPREAD
    P(w) = max(n(w) - DISCOUNT, 0) / N + DISCOUNT V / N spelled(w)

The end has no spelling, and is what stands before a text's first word. spelled(w) is the
probability of the word's bytes and of its end by n-grams of up to ORDER bytes, in
interpolated absolute discounting. The probabilities of all continuations of a state sum
to one, and any text, known words or not, has one.

What grows. All words and all pairs of words of all training documents count, be it once. Each
block of documents sends its distinct words and pairs, in order, in parts by range of hash;
a part's task adds up all blocks and answers each with the numbers alone, in the same order,
so a pair costs about seven bytes of shuffle and a pair that no other block has costs none back.
The spelling is the one thing that is broadcast. Its n-grams are counted in full. Those of three bytes are
at most 2**24 whatever the corpus, and with order 3 (op5_lm_score) the model does not depend on their number. A longer
order is a caller's choice: where its n-grams are more than ARCS (86,000 of four bytes in 173 MB of text), the longest that are not are used.

Edge cases. Null text: empty, only the end is scored. A null doc_id is not held out.
Without training documents every byte has probability 1/256, the end 1/2, and the base is 0.
Rows that repeat a doc_id count as documents of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_of, materialise, text_bytes
from .textkit import _U, Words, gathered, mix, raw_texts, signed

#: Bytes of the longest n-gram of the spelling; distinct n-grams that may be broadcast, beyond those of three bytes.
ORDER, ARCS = 4, 4_000_000
DISCOUNT = 0.75
#: Bytes of text in a block; bytes that one lane of the traversal covers.
BLOCK_BYTES, LANE = 8_000_000, 512
#: Parts that pairs are added up in: one a block up to so many, then one for eight blocks.
PARTS = 4096
#: The frequencies of single words weigh PRIOR * (n + 1) ** SPREAD sightings against what followed a word seen n times.
PRIOR, SPREAD = 2.0, 0.75
#: Even, as words are; pairs of words are odd. Before a text stands what ends one.
_END = np.int64(-0x3C6EF372FE94F82C)


def _grams(order: int):
    """n-grams of order bytes of all words, each with order - 1 newlines before and one after, as integers, and their number, by task."""
    pad = b"\n" * order

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        k, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.argsort(k, kind="stable")
        k, c = k[o], c[o]
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        return k[at], np.add.reduceat(c, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            raw = raw_texts(batch.column(0))
            for a, b in gathered(raw):
                words = b" ".join(raw[a:b]).lower().split()
                if not words:
                    continue
                # n-grams that end in the newlines before a word are none of its own
                buf = np.frombuffer(pad[1:] + pad.join(words) + b"\n", np.uint8)
                end = np.flatnonzero((buf[order - 1 :] != 10) | (buf[order - 2 : -1] != 10))
                key = np.zeros(len(end), np.uint64)
                for j in range(order):
                    key = (key << _U(8)) | buf[end + j]
                if order <= 4:
                    key = key.astype(np.uint32)
                k, n = np.unique(key, return_counts=True)
                held.append((k.astype(np.int64), n))
                if len(held) > 8:
                    held = [merged(held)]
        if held:
            k, n = merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return run


class Automaton:
    """States, arcs and failure arcs, in arrays.

    counts[k]: n-grams of k bytes as integers, in order, and their numbers; total: all bytes scored in training; texts: training texts."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]], total: int, texts: int, order: int = ORDER):
        self.order = order
        one = np.full(256, 1.0 / (total + 256))
        if 1 in counts:
            one[counts[1][0]] += counts[1][1] / (total + 256)
        state_of: list[np.ndarray] = [np.zeros(1, np.int64)]  # contexts of each length, in order
        offset = [0, 1]
        arc_state, arc_byte, arc_p, fail_w, fail_to = [np.zeros(256, np.int64)], [np.arange(256)], [one], [np.ones(1)], [np.zeros(1, np.int64)]
        by_order = {1: (np.arange(256), one)}
        for k in range(2, order + 1):
            gram, n = counts.get(k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            context = gram >> 8
            states, at = np.unique(context, return_inverse=True)
            lower, lower_n = counts.get(k - 1, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            newline = sum(10 << (8 * j) for j in range(k - 1))
            where = np.searchsorted(lower, states)
            here = np.minimum(where, max(len(lower) - 1, 0))
            base = np.where(states == newline, texts, lower_n[here] if len(lower) else 0).astype(float)
            direct = np.maximum(n - DISCOUNT, 0) / base[at] if len(gram) else np.zeros(0)
            left = 1.0 - np.bincount(at, direct, len(states))
            suffix = gram & ((1 << (8 * (k - 1))) - 1)
            known, p = by_order[k - 1]
            p_lower = p[np.searchsorted(known, suffix)]
            both = direct + left[at] * p_lower
            by_order[k] = (gram, both)
            state_of.append(states)
            arc_state.append(at + offset[-1])
            arc_byte.append(gram & 255)
            arc_p.append(both)
            fail_w.append(left)
            shorter = states & ((1 << (8 * (k - 2))) - 1) if k > 2 else np.zeros(len(states), np.int64)
            fail_to.append(np.searchsorted(state_of[k - 2], shorter) + offset[k - 2])
            offset.append(offset[-1] + len(states))
        state, byte = np.concatenate(arc_state), np.concatenate(arc_byte).astype(np.int64)
        self.fail_to, self.fail_w = np.concatenate(fail_to), np.log10(np.maximum(np.concatenate(fail_w), 1e-300))
        # where an arc leads: the longest suffix of its n-gram that is a state
        grams = np.concatenate([np.arange(256), *[counts.get(k, (np.zeros(0, np.int64),))[0] for k in range(2, order + 1)]])
        length = np.concatenate([np.full(len(x), i + 1) for i, x in enumerate(arc_state)])
        to = np.zeros(len(grams), np.int64)
        for k in range(1, order):
            s = state_of[k]
            tail = grams & ((1 << (8 * k)) - 1)
            at = np.minimum(np.searchsorted(s, tail), max(len(s) - 1, 0))
            ok = (length >= k) & (s[at] == tail) if len(s) else np.zeros(len(grams), bool)
            to[ok] = at[ok] + offset[k]
        self._hash(state * 256 + byte, np.log10(np.concatenate(arc_p)), to)
        start = 0
        for k in range(1, order):
            newline = sum(10 << (8 * j) for j in range(k))
            at = np.searchsorted(state_of[k], newline)
            if at < len(state_of[k]) and state_of[k][at] == newline:
                start = int(at) + offset[k]
        self.start = start

    def _hash(self, key: np.ndarray, weight: np.ndarray, to: np.ndarray) -> None:
        bits = max(10, int(len(key) * 2.5).bit_length())
        self.shift = _U(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.weight, self.to = np.zeros(1 << bits), np.zeros(1 << bits, np.int64)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            s, i = slot[put], left[put]
            self.keys[s], self.weight[s], self.to[s] = key[i], weight[i], to[i]
            left, slot = left[~put], (slot[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(_U) * _U(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New states and log10 probabilities of these bytes."""
        state = state.copy()
        gained = np.zeros(len(state))
        want = np.arange(len(state))
        key = state * 256 + byte
        slot = self._slot(key)
        to = np.zeros(len(state), np.int64)
        mask = len(self.keys) - 1
        while len(want):
            there = self.keys[slot]
            hit = there == key
            at, s = want[hit], slot[hit]
            gained[at] += self.weight[s]
            to[at] = self.to[s]
            rest = ~hit
            want, key, slot, there = want[rest], key[rest], slot[rest], there[rest]
            gone = there < 0  # no such arc: along the failure arc
            slot = (slot + 1) & mask
            if gone.any():
                f = want[gone]
                gained[f] += self.fail_w[state[f]]
                state[f] = self.fail_to[state[f]]
                key[gone] = state[f] * 256 + byte[f]
                slot[gone] = self._slot(key[gone])
        return to, gained

    def traverse(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each byte of the texts, each with its end, in order.

        Long texts are cut into lanes that all move a byte at a time; a lane first
        reads the order - 1 bytes before it, after which its state is that of one traversal."""
        pad = self.order - 1
        size = np.array([len(x) + 1 for x in texts], np.int64)
        lanes = -(-size // LANE)
        buf = np.frombuffer(b"".join(b"\n" * pad + x + b"\n" for x in texts), np.uint8)
        before = np.cumsum(size) - size
        of = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        length = np.minimum(size[of] - nth * LANE, LANE)
        order = np.argsort(-length, kind="stable")
        of, nth, length = of[order], nth[order], length[order]
        origin = before[of] + nth * LANE
        read = origin + pad * of  # where the lane's warm-up begins in buf
        state = np.full(len(of), self.start, np.int64)
        later = np.flatnonzero(nth > 0)
        state[later] = 0
        for j in range(pad if len(later) else 0):
            state[later], _ = self.step(state[later], buf[read[later] + j].astype(np.int64))
        out = np.zeros(int(size.sum()))
        for j in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -j, side="left"))
            state[:n], out[origin[:n] + j] = self.step(state[:n], buf[read[:n] + pad + j].astype(np.int64))
        return out


def train(docs: DataFrame, train_col: Column, *, text_col: str = "text", order: int = ORDER) -> Automaton:
    """The spelling automaton of the words of the documents where train_col is true."""
    grams = docs.filter(train_col).select(F.col(text_col)).mapInArrow(_grams(order), "gram long, n long")
    grams = materialise(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    while order > 3 and grams.count() > ARCS:
        order -= 1
        grams = materialise(grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1)).alias("gram")).agg(F.sum("n").alias("n")), "grams")
    t = grams.toArrow()
    gram, n = (t[c].combine_chunks().to_numpy() for c in ("gram", "n"))
    counts = {}
    for k in range(1, order + 1):
        key, at = np.unique(gram & ((1 << (8 * k)) - 1), return_inverse=True)
        counts[k] = key, np.bincount(at, n, len(key)).astype(np.int64)
    ends = counts[1][1][counts[1][0] == 10]
    return Automaton(counts, int(n.sum()), int(ends.sum()), order)


def _sequence(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words and its end, and what stands before each."""
    n = np.diff(w.bounds)
    out = np.full(len(w.hash) + len(n), _END)
    out[np.arange(len(w.hash)) + np.repeat(np.arange(len(n)), n)] = signed(w.hash) & np.int64(-2)
    return out, np.concatenate((np.array([_END]), out[:-1]))


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return signed(mix(mix(before.view(_U)) * _U(0xC2B2AE3D27D4EB4F) + word.view(_U))) | np.int64(1)


class _Block:
    """The words and pairs of a block of documents: distinct keys in unsigned order, and each token's."""

    def __init__(self, docs: pa.Table):
        self.raw = raw_texts(docs["text"])
        self.held = [(a, b, Words(self.raw[a:b], lower=True)) for a, b in gathered(self.raw)]
        both = [_sequence(w) for _, _, w in self.held]
        self.each = np.concatenate([x for x, _ in both])
        self.before = np.concatenate([x for _, x in both])
        tokens = np.concatenate([np.diff(w.bounds) + 1 for _, _, w in self.held])
        self.of = np.repeat(np.arange(len(self.raw)), tokens)
        train_ = np.asarray(docs["train"].combine_chunks().cast(pa.int8()))[self.of]
        keys = np.concatenate([self.each, _pairs(self.before, self.each)]).view(_U)
        self.keys, at = np.unique(keys, return_inverse=True)
        self.word_at, self.pair_at = at[: len(self.each)], at[len(self.each) :]
        self.n = np.bincount(at, np.concatenate([train_, train_]), len(self.keys)).astype(np.int64)

    def count_of(self, n: np.ndarray, words: np.ndarray) -> np.ndarray:
        """n of words that the block holds."""
        return n[np.searchsorted(self.keys, words.view(_U))]


def _packed(keys: np.ndarray) -> bytes:
    """Keys in order: the first, and the bytes of the differences, no more of each than the greatest needs."""
    step = np.diff(keys)
    width = max(1, -(-int(step.max()).bit_length() // 8)) if len(step) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    out = np.zeros((len(raw) + 1, 8), np.uint8)
    out[0] = np.frombuffer(data, np.uint8, 8, 1)
    out[1:, : data[0]] = raw
    return np.cumsum(out.view("<u8").ravel(), dtype=_U)


def _word_counts(parts: int):
    """A block's keys and their numbers in training, by part."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        block = _Block(docs)
        part = ((block.keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = np.append(at[1:], len(part))
        n = block.n.astype(np.int32)
        return pa.table(
            {
                "part": pa.array(part[at], pa.int32()),
                "blk": pa.array(np.full(len(at), key[0]), pa.int32()),
                "keys": pa.array([_packed(block.keys[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()),
                "n": pa.array([n[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
            }
        )

    return run


def _totals(key: tuple, rows: pa.Table) -> pa.Table:
    """What other blocks add to each block's numbers; with the part's first block the part's words and those that are distinct."""
    rows = rows.sort_by("blk")
    keys = [_unpacked(x) for x in rows["keys"].to_pylist()]
    n = np.concatenate([np.frombuffer(x, np.int32) for x in rows["n"].to_pylist()])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, n, len(distinct)).astype(np.int64)
    word = ((distinct & _U(1)) == 0) & (total > 0)
    more = total[at] - n
    cut = np.cumsum([len(k) for k in keys])[:-1]
    lead = np.arange(rows.num_rows) == 0
    return pa.table(
        {
            "blk": rows["blk"].cast(pa.int32()),
            "part": rows["part"].cast(pa.int32()),
            "more": pa.array([x.tobytes() for x in np.split(more, cut)], pa.binary()),
            "tokens": pa.array(np.where(lead, int(total[word].sum()), 0), pa.int64()),
            "types": pa.array(np.where(lead, int(word.sum()), 0), pa.int64()),
        }
    )


def _scores(model):
    def run(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        block = _Block(docs)
        known = known.sort_by("part")
        total, types = (known[c][0].as_py() for c in ("all_tokens", "all_types"))
        count = block.n + np.concatenate([np.frombuffer(x, np.int64) for x in known["more"].to_pylist()])
        rows = len(block.raw)
        each, of = block.each, block.of
        is_end = each == _END
        n = count[block.word_at]
        base = np.log10(n + 1) - np.log10(total + types + 1)
        # spelled once for each distinct word
        here, first, back = np.unique(each, return_index=True, return_inverse=True)
        cut = np.cumsum([0, *[len(w.hash) + b - a for a, b, w in block.held]])
        word = [b""] * len(here)
        for (_, _, w), lo, hi in zip(block.held, cut[:-1], cut[1:], strict=True):
            ends = np.cumsum(is_end[lo:hi])
            for i in np.flatnonzero((first >= lo) & (first < hi) & (here != _END)):
                j = first[i] - lo - ends[first[i] - lo]
                word[i] = w.data[w.start[j] : w.end[j]]
        size = np.array([len(x) + 1 for x in word])
        byte = np.add.reduceat(model.value.traverse(word), np.cumsum(size) - size)
        if total:
            n_here = block.count_of(count, here)
            single = np.maximum(n_here - DISCOUNT, 0) / total
            rest = np.log10(DISCOUNT * types / total)
        else:
            single, rest = np.where(here == _END, 0.5, 0.0), np.log10(0.5)
        # in logarithms: a long word's spelling is less than the least number
        with np.errstate(divide="ignore"):
            log_single = np.logaddexp2(np.log2(single), np.where(here == _END, -np.inf, (byte + rest) / np.log10(2))) * np.log10(2)
            sightings = block.count_of(count, block.before) if total else np.zeros(len(each))
            prior = PRIOR * (sightings + 1.0) ** SPREAD
            seen = np.log2(count[block.pair_at] / (sightings + prior))
            failed = np.log2(prior / (sightings + prior)) + log_single[back] / np.log10(2)
            score = np.logaddexp2(seen, failed) * np.log10(2)
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": docs["held_out"],
                "n_tokens": np.bincount(of, minlength=rows).astype(np.int64),
                "n_known": np.bincount(of, n > 0, rows).astype(np.int64),
                "train_tokens": np.full(rows, total, np.int64),
                "base_score": np.bincount(of, base, rows),
                "score": np.bincount(of, score, rows),
            }
        )

    return run


def lm_scores(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one word frequencies), score. Documents with held_out true are not learnt from."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = spark.sparkContext.broadcast(train(docs, ~F.col("held_out"), order=order))
    blocks = max(1, -(-text_bytes(docs, "text") // BLOCK_BYTES))
    parts = max(min(blocks, PARTS), blocks // 8)
    dealt = docs.withColumn("train", ~F.col("held_out")).withColumn("blk", block_of(F.col("doc_id"), F.col("text"), blocks))
    seen = dealt.groupBy("blk").applyInArrow(_word_counts(parts), "part int, blk int, keys binary, n binary")
    totals = seen.groupBy("part").applyInArrow(_totals, "blk int, part int, more binary, tokens long, types long")
    sizes = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("all_types"))
    known = totals.select("blk", "part", "more").crossJoin(F.broadcast(sizes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("blk").cogroup(known.groupBy("blk")).applyInArrow(
        _scores(model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
