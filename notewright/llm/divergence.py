"""Audit of how sources diverge from each other and from their language, term by term.

Method. A source's smoothed share p of a term against another distribution's share q diverges by
floor((p - q)^2 / q). Shares are whole numbers of billionths, so all sums are exact.

Pairs. Most terms are absent from most sources, where both have their baseline share (of count 0). A pair's
divergence is that of the baselines over all terms, corrected where either source has the term (by a source's numbers of
terms of equal share) and corrected again where both do (in blocks of terms). No row is made for a pair and a term.

Ranks. The k-th greatest value of each group is found by radix select: histograms over 15 bits of the values, from the
top, tell in which bin it lies; values above it are in, those below are out, and the bin itself is looked into by the
next bits. Values that tie at the end are told apart by their UTF-8 bytes, two at a time, in the same way. Only the k rows that are
left are ranked.

Scale. Texts are read once; tasks send counts of (lang, source, term), summed before the shuffle. Histograms are
summed before theirs too, so a group that holds a third of all terms is no single task. What is sent of a group is one row for each bin, BINS at
most. Terms in all sources are in one block with one row for each source.

Edge cases. Null text, lang and source are ''. Rows that repeat an id are documents of their own. A language whose terms
are all rare has V = 0: its pairs have value 0 and it has no terms. A group without terms has baseline shares. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .textkit import gathered, parts, raw_texts
from .tokens import ragged

BILLION = 1_000_000_000
LEAST, TOP = 3, 200
#: Bits of a value that one histogram tells apart; values are below 2**60.
BITS, DIGITS = 15, 4
BINS = 1 << BITS
#: Bytes of a term that one histogram tells apart.
BYTES = 2
#: Rows of counts in a block of terms.
BLOCK_ROWS = 100_000
#: Ties that are ranked as they are.
FEW = 1000

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_GROUP = ["lang", "source"]


def _terms(raw: list[bytes]) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """Numbers of the distinct terms of all texts in order, the distinct terms, and the text of each."""
    data = b"\n".join(raw).lower()  # only A-Z, as these are bytes
    word = _LETTER[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    # what stands between two terms is an entry of its own, left out afterwards
    offsets = np.concatenate(([0], edge, [len(data)])).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    found = pieces.take(pa.array(np.arange(len(start)) * 2 + 1)).dictionary_encode()
    first = np.cumsum([0, *(len(x) + 1 for x in raw)])
    return np.asarray(found.indices), found.dictionary, np.searchsorted(first, start, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents); with the term '' for the group itself."""
    for batch in parts(batches, 5000):
        raw = raw_texts(batch.column(2))
        langs, sources = (np.asarray(c.dictionary_encode().indices) for c in batch.columns[:2])
        groups, group = np.unique(langs.astype(np.int64) << 32 | sources, return_inverse=True)
        one = [int(np.flatnonzero(group == g)[0]) for g in range(len(groups))]
        names = batch.select([0, 1]).take(pa.array(one, pa.int64()))
        yield pa.RecordBatch.from_arrays([*names.columns, pa.array([""] * len(one)), *[pa.array([0] * len(one), pa.int64())] * 2], names=["lang", "source", "term", "n", "docs"])
        for a, b in gathered(raw, 8 << 20):
            number, distinct, of = _terms(raw[a:b])
            if not len(number):
                continue
            size = len(distinct)
            held, n = np.unique(of * size + number, return_counts=True)
            keys, at = np.unique(group[a:b][held // size].astype(np.int64) * size + held % size, return_inverse=True)
            total = np.bincount(at, weights=n).astype(np.int64)
            rows = names.take(pa.array(keys // size))
            term = distinct.take(pa.array(keys % size)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns, term, pa.array(total), pa.array(np.bincount(at))], names=["lang", "source", "term", "n", "docs"])


def share(n: str, total: str) -> str:
    """1 + floor(10^9 * (n + 1) / total), exactly."""
    return f"(1 + CAST({BILLION} AS DECIMAL(10, 0)) * (CAST({n} AS DECIMAL(20, 0)) + 1) div CAST({total} AS DECIMAL(20, 0)))"


def diverge(p: str, q: str) -> str:
    """floor((p - q)^2 / q)."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _both_present(key: tuple, rows: pa.Table) -> pa.Table:
    """Corrections for the terms of a block that both sources of a pair have: source, item, value."""
    source, term = (rows[c].combine_chunks().dictionary_encode() for c in ("source", "term"))
    names, of, t = source.dictionary, np.asarray(source.indices), np.asarray(term.indices)
    order = np.argsort(t, kind="stable")
    of, t, p, base = of[order], t[order], np.asarray(rows["p"])[order], np.asarray(rows["p0"])[order]
    start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    length = np.diff(np.append(start, len(t)))
    f = lambda x, y: (x - y) * (x - y) // y
    left, right, value = [], [], []
    by_source = np.argsort(of, kind="stable")
    for own in np.split(by_source, np.flatnonzero(np.diff(of[by_source])) + 1):
        at = ragged(start[t[own]], length[t[own]])
        pa_, p0 = np.repeat(p[own], length[t[own]]), base[own[0]]
        total = np.zeros(len(names), np.int64)
        np.add.at(total, of[at], f(pa_, p[at]) - f(pa_, base[at]) - f(p0, p[at]) + f(p0, base[at]))
        a = int(of[own[0]])
        total[a] = 0
        there = np.flatnonzero(total)
        left += [a] * len(there)
        right.append(there)
        value.append(total[there])
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"lang": pa.array([key[0]] * len(left), pa.string()), "source": names.take(pa.array(left, pa.int64())), "item": names.take(pa.array(joined(right))), "value": pa.array(joined(value), pa.int64())})


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term, and of each group one row with the term ''."""
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    made = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _hex(length: str) -> str:
    """A term's bytes as hexadecimal digits, so many; a shorter term sorts before its continuations."""
    return f"substring(rpad(hex(CAST(term AS BINARY)), {length}, '0'), 1, {length})"


def greatest(values: DataFrame, top: int) -> DataFrame:
    """The top rows of each (lang, source) by value, descending, then term: with rank. values: lang, source, term, value, 0 <= value < 2**60, terms distinct in a group."""
    sizes = values.groupBy(*_GROUP).agg(F.count("*").alias("rows"))
    sizes = materialise(sizes, "groups")
    few = F.col("rows") <= top + FEW
    bounds = [sizes.filter(few).select(*_GROUP, F.lit(0).cast("long").alias("low"), F.lit(None).cast("string").alias("last"))]
    left = sizes.filter(~few).select(*_GROUP, F.lit(0).cast("long").alias("prefix"), F.lit(top).cast("long").alias("k"))

    def crossed(rows: DataFrame, order: Column, prefix: Column) -> DataFrame:
        """Of each group the bin in which the k-th row lies, what is left of k there and the bin's rows."""
        bins = rows.groupBy(*_GROUP, "prefix", "k", "bin").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*_GROUP).orderBy(order))
        at = bins.withColumn("before", upto - F.col("n")).filter("before < k AND before + n >= k")
        return materialise(at.select(*_GROUP, prefix.alias("prefix"), (F.col("k") - F.col("before")).alias("k"), "n"), "bins")

    for digit in range(DIGITS):
        if left.isEmpty():
            break
        shift = BITS * (DIGITS - 1 - digit)
        rows = values.join(left, _GROUP).filter(F.shiftright("value", shift + BITS) == F.col("prefix"))
        at = crossed(rows.withColumn("bin", F.shiftright("value", shift).bitwiseAND(F.lit(BINS - 1))), F.desc("bin"), F.col("prefix") * BINS + F.col("bin"))
        bounds.append(at.filter(F.col("n") <= FEW).select(*_GROUP, F.shiftleft("prefix", shift).alias("low"), F.lit(None).cast("string").alias("last")))
        left = at.filter(F.col("n") > FEW).drop("n")
    ties, length = left.withColumnRenamed("prefix", "low").withColumn("prefix", F.lit("")), 0
    while not ties.isEmpty():
        rows = values.join(ties, _GROUP).filter(F.expr(f"value = low AND {_hex(str(length))} = prefix"))
        length += 2 * BYTES
        low = ties.select(*_GROUP, "low")
        at = crossed(rows.withColumn("bin", F.expr(_hex(str(length)))), F.asc("bin"), F.col("bin")).join(low, _GROUP)
        bounds.append(at.filter(F.col("n") <= FEW).select(*_GROUP, "low", F.col("prefix").alias("last")))
        ties = at.filter(F.col("n") > FEW).drop("n")
    inside = F.expr(f"value > low OR value = low AND (last IS NULL OR {_hex('length(last)')} <= last)")
    rows = values.join(reduce(DataFrame.union, bounds), _GROUP).filter(inside).drop("low", "last")
    rank = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "term"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def source_divergence(docs: DataFrame, *, least: int = LEAST, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block_rows: int = BLOCK_ROWS, salts: int = 16) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: each other source of the language, by divergence over its terms in at least
    ``least`` documents. Part term: the ``top`` terms that the source has more of than the language."""
    counts = materialise(term_counts(docs, lang_col=lang_col, source_col=source_col, text_col=text_col), "term-counts")
    terms = counts.filter("term <> ''")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.min("source").alias("one")).filter(F.col("docs") >= least).drop("docs")
    rows = materialise(terms.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    langs = rows.groupBy("lang").agg(F.sum("n").alias("all"), F.sum((F.col("source") == F.col("one")).cast("long")).alias("v"), F.ceil(F.count("*") / block_rows).alias("blocks"))
    sums = rows.groupBy(*_GROUP).agg(F.sum("n").alias("n"))
    sources = counts.filter("term = ''").select(*_GROUP).join(sums, _GROUP, "left").join(langs, "lang", "left")
    sources = sources.select(*_GROUP, F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n", F.lit(0)) + F.col("v")).alias("total"), (F.col("all") + F.col("v")).alias("total_lang"), "blocks")
    sources = materialise(sources.withColumn("p0", F.expr(f"CASE WHEN v > 0 THEN {share('0', 'total')} END")), "sources")

    shares = rows.join(sources, _GROUP).withColumn("p", F.expr(share("n", "total")))
    values = shares.withColumn("q", F.expr(share("n_lang", "total_lang"))).filter("p > q").select(*_GROUP, "term", F.expr(diverge("p", "q")).alias("value"))
    best = greatest(materialise(values, "term-values"), top).withColumnRenamed("term", "item")

    side = sources.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = sources.join(side, "lang").filter("source <> item").select(*_GROUP, "item", F.expr(f"CASE WHEN v > 0 THEN v * {diverge('p0', 'q0')} ELSE 0 END").alias("value"))
    # a source's terms of equal counts, against the baselines of all others; a language's rows are dealt to several tasks
    alike = shares.groupBy(*_GROUP, "p", "p0").agg(F.count("*").alias("m")).withColumn("salt", F.pmod(F.hash("source", "p"), F.lit(salts)))
    others = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    one = alike.join(others, ["lang", "salt"]).filter("source <> item").groupBy(*_GROUP, "item").agg(
        F.expr(f"sum(m * ({diverge('p', 'q0')} - {diverge('p0', 'q0')}))").alias("own"), F.expr(f"sum(m * ({diverge('q0', 'p')} - {diverge('q0', 'p0')}))").alias("other")
    )
    both = shares.withColumn("block", F.expr("pmod(xxhash64(term), blocks)")).select("lang", "block", "source", "term", "p", "p0")
    both = both.groupBy("lang", "block").applyInArrow(_both_present, "lang string, source string, item string, value long")
    swapped = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("other").alias("value"))
    pairs = base.union(one.select(*_GROUP, "item", F.col("own").alias("value"))).union(swapped).union(both).groupBy(*_GROUP, "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").union(columns(best, "term"))
