"""Mentions and cues of many texts at a time.

functions.text.mentions and cue, on batches: Arrow's expressions go over a text in one step a letter, which the JVM's don't.
Sentences are judged once a batch; what they say is read from the mentions in columns, as ever."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import patterns as P
from ..functions.text import _END, _MARK, BLANKS

_GAP = rf"([.!?;])[{BLANKS}][{BLANKS}{_MARK}]*|[{BLANKS}]*[\n{_MARK}][{BLANKS}{_MARK}]*"
#: White space is what it is to the JVM; the sentences are in lower case.
_STARTS, _GOES_ON, _CUE = (p.replace(r"\s", f"[{BLANKS}]") for p in (P.MENTION_START, P.MENTION_GOES_ON, P.CUE))
#: Letters, digits and accents beyond ASCII, which are part of a word.
_WORDLY = r"[^\x00-\x7F\PL]|[^\x00-\x7F\P{Nd}]|\p{Mn}"
#: A header after the end of a line, which for the JVM these letters are too; both cases are spelled out, as no letter beyond ASCII is to be folded.
_HEADER = "|".join(re.sub("[A-Z]", lambda m: f"[{m[0]}{m[0].lower()}]", h) for h in P.HEADERS)
_LINE = "\uffff"  # no character: put after a return that ends a line, as the blanks after a header before may take the return itself
_HEAD = f"(?m)(^|[{_LINE}\x85\u2028\u2029])[{BLANKS}]*({_HEADER})[{BLANKS}{_LINE}]*(?::[{BLANKS}]*|\n+)"


def _sections(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Findings and impression of functions.text.sections."""
    texts = texts.cast(pa.string())
    if returns := pc.any(pc.match_substring(texts, "\r")).as_py():
        texts = pc.replace_substring(pc.replace_substring(texts, "\r", f"\r{_LINE}"), f"\r{_LINE}\n", "\r\n")
    cut = pc.split_pattern(pc.replace_substring_regex(texts, _HEAD, rf"\1{_MARK}\2{_END}"), _MARK)
    parts, rows = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy()
    low = pc.ascii_lower(parts)

    def last(*headers: str) -> pa.Array:
        hits = [pc.starts_with(low, f"{h}{_END}").to_numpy(zero_copy_only=False).astype(bool) for h in headers]
        at = np.flatnonzero(np.logical_or.reduce(hits))
        at = at[np.append(rows[at][1:] != rows[at][:-1], True)[: len(at)]]
        body = pc.list_element(pc.split_pattern(parts.take(pa.array(at)), _END, max_splits=1, reverse=True), 1)
        body = pc.utf8_trim(pc.replace_substring(body, _LINE, "") if returns else body, BLANKS)
        body = pc.if_else(pc.equal(body, ""), pa.scalar(None, pa.string()), body)
        place = np.full(len(texts), -1)
        place[rows[at]] = np.arange(len(at))
        return body.take(pa.array(place, mask=place < 0))

    return last("findings"), pc.coalesce(last("impression"), last("recommendation", "recommendation(s)"))


def _sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All sentences, and the row of each."""
    marked = pc.replace_substring_regex(pc.utf8_trim(texts.cast(pa.string()), BLANKS), _GAP, rf"\1{_MARK}")
    cut = pc.split_pattern(marked, _MARK)
    values, rows = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy()
    full = pc.greater(pc.binary_length(values), 0)
    return values.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def _judged(sentences: pa.Array, *patterns: str) -> list[np.ndarray]:
    """Whether each pattern matches, by sentence."""
    coded = sentences.dictionary_encode()
    low = pc.ascii_lower(coded.dictionary)
    if not pc.all(pc.string_is_ascii(low)).as_py():
        low = pc.replace_substring_regex(low, _WORDLY, "_")
    code = coded.indices.to_numpy()
    return [pc.match_substring_regex(low, p).to_numpy(zero_copy_only=False).astype(bool)[code] for p in patterns]


def _ends(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def _joined(sentences: pa.Array, which: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The sentences at which, so many in a row joined to one text."""
    return pc.binary_join(pa.ListArray.from_arrays(_ends(counts), sentences.take(pa.array(which))), " ")


def _mentions(sentences: pa.Array, row: np.ndarray, n: int) -> pa.ListArray:
    starts, goes_on = _judged(sentences, _STARTS, _GOES_ON)
    at, first = np.arange(len(row)), np.flatnonzero(starts)
    stops = ~starts & ~(goes_on & (row == np.concatenate([[-1], row[:-1]])[: len(row)]))
    begun, stopped = (np.maximum.accumulate(np.where(x, at, -1)) for x in (starts, stops))
    member = np.flatnonzero(begun > stopped)
    counts = np.bincount(np.searchsorted(first, begun[member]), minlength=len(first))
    return pa.ListArray.from_arrays(_ends(np.bincount(row[first], minlength=n)), _joined(sentences, member, counts))


def _cues(sentences: pa.Array, row: np.ndarray, n: int) -> pa.Array:
    hits = np.flatnonzero(_judged(sentences, _CUE)[0])
    counts = np.bincount(row[hits], minlength=n)
    return pc.if_else(pa.array(counts > 0), _joined(sentences, hits, counts), pa.scalar(None, pa.string()))


def _cut(columns: list[pa.Array], cue: pa.Array | None) -> tuple[pa.ListArray, pa.Array]:
    """Mentions of the first text of each row that has any, and the cue of cue, or of the first column (None)."""
    n = len(columns[0])
    sentences = _sentences(columns[0])
    found = _mentions(*sentences, n)
    for c in columns[1:]:
        none = pc.equal(pc.list_value_length(found), 0)
        if pc.any(none).as_py():
            found = pc.if_else(none, _mentions(*_sentences(pc.if_else(none, c, pa.scalar(None, pa.string()))), n), found)
    return found, _cues(*(sentences if cue is None else _sentences(cue)), n)


def cut(rows: DataFrame, texts: tuple[str, ...], cue: str) -> DataFrame:
    """rows without texts and cue, with found: the mentions of the first of texts that has any, and cue: that of the text named."""
    kept = [f for f in rows.schema if f.name not in (*texts, cue)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = _cut([b[t] for t in texts], None if cue == texts[0] else b[cue])
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in kept), *done], names=[*(f.name for f in kept), "found", "cue"])

    schema = StructType([*kept, StructField("found", ArrayType(StringType())), StructField("cue", StringType())])
    return rows.select(*[f.name for f in kept], *dict.fromkeys((*texts, cue))).mapInArrow(each, schema)


def cut_reports(rows: DataFrame, text: str) -> DataFrame:
    """rows without the text, with found: the mentions of its findings or else its impression, and cue: that of its impression and all of it."""
    kept = [f for f in rows.schema if f.name != text]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            findings, impression = _sections(b[text])
            both = pc.binary_join_element_wise(*(pc.fill_null(x.cast(pa.string()), "") for x in (impression, b[text])), " ")
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in kept), *_cut([findings, impression], both)], names=[*(f.name for f in kept), "found", "cue"])

    schema = StructType([*kept, StructField("found", ArrayType(StringType())), StructField("cue", StringType())])
    return rows.select(*[f.name for f in kept], text).mapInArrow(each, schema)
