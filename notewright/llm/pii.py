"""Personal data: patterns, and terms that reveal them by corpus co-occurrence.

Method. Protected entities are the values that the base patterns find. All other words
of a document that holds one are terms that may give it away. Over
the whole corpus: documents with the entity, documents with the term, and documents with
both. A term's disclosure of an entity is the share of the entity's information
content that it conveys, PMI(e; t) / IC(e) = 1 - log p(e|t) / log p(e). A term
above GENERALISE is replaced by a placeholder wherever a document with that entity has it, one above
REMOVE is removed. One co-occurrence proves nothing: the pair must be seen in SUPPORT
groups of near-duplicates, so that copies of one text do not count twice.

Scale. Texts are read twice for patterns: to find entities, of which hashes travel, and to
give each row its spans and sanitised text. Only the texts of entities that SUPPORT
different texts hold travel, each once, and are grouped; a term is paired with an entity
only if it is rare enough to give it away. Document frequencies are summed by task first. The
spans of disclosing terms go to the texts that have them, by broadcast while they are few.

Edge cases. Null text: empty. Rows that repeat an id are documents of their own.
Spans are code points, end exclusive; of spans that overlap the sanitised text has one placeholder,
the first's. Overlong runs cost linear time. Other columns, clashing or not, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialise, salted_join
from .near_dedup import near_duplicate_groups
from .spans import joined, key_of
from .textkit import Words, gathered, parts, raw_texts, signed

KINDS = ("email", "ip", "card", "phone", "general", "remove")
SUPPORT, GENERALISE, REMOVE = 3, 0.85, 0.95
#: Texts are copies if they share so many per cent of their runs of so many words.
SHINGLE, PERCENT = 5, 80
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match never begins inside a run of digits: that run's first digit would have matched or failed alike.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ADDED = "array<struct<kind:string,start:int,end:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        local = _local_start(text, free, at)
        m = DOMAIN.match(text, at + 1) if local < at else None
        free = at + 1
        if m:
            yield local, m.end()
            free = m.end()
        at = text.find("@", free)


def _local_start(text: str, free: int, at: int) -> int:
    i = at
    while i > free and (text[i - 1].isascii() and (text[i - 1].isalnum() or text[i - 1] in "._%+-")):
        i -= 1
    return i


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, hash of the value)."""
    out = []
    if "@" in text:
        out += [("email", s, e, key_of(text[s:e].lower())) for s, e in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end(), key_of(m[0])))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end(), key_of(digits)))
        if "+" in text:
            for m in PHONE.finditer(text):
                digits = "".join(DIGIT.findall(m[0]))
                if 10 <= len(digits) <= 15:
                    out.append(("phone", m.start(), m.end(), key_of(digits)))
    return out


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with personal data: its distinct values."""
    for batch in batches:
        keys = [sorted({k for *_, k in base_spans(t or "")}) for t in batch.column(1).to_pylist()]
        some = [i for i, k in enumerate(keys) if k]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int32())), pa.array([keys[i] for i in some], pa.list_(pa.int64()))], names=["text_hash", "entities"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text that are part of no entity, and where they are."""
    place = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for i, text in enumerate(batch.column(1).to_pylist()):
            word = [(m.start(), m.end()) for m in WORD.finditer(text)]
            begin = np.array([s for s, _ in word])
            taken = np.zeros(len(word) + 1, bool)
            for _, s, e, _ in base_spans(text):
                taken[int(np.searchsorted(begin, s, side="right")) - 1 : int(np.searchsorted(begin, e, side="left"))] = True
            hashed = signed(Words([b" ".join(text[s:e].encode("utf-8", "surrogatepass").lower() for s, e in word)], lower=False).hash).tolist()
            out = [{"term": h, "start": s, "end": e} for h, (s, e), gone in zip(hashed, word, taken, strict=False) if not gone]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([out], place)], names=["text_hash", "terms"])


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word, summed over parts of a task."""
    held: list = []

    def merged():
        k, n = (np.concatenate(x) for x in zip(*held, strict=True))
        word, at = np.unique(k, return_inverse=True)
        return word, np.bincount(at, n, len(word)).astype(np.int64)

    for batch in batches:
        raw = raw_texts(batch.column(0))
        for a, b in gathered(raw):
            w = Words(raw[a:b], lower=True)
            of = np.repeat(np.arange(b - a), np.diff(w.bounds))
            order = np.lexsort((of, w.hash))
            h, of = w.hash[order], of[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1]))) if len(h) else np.zeros(0, bool)
            held.append(np.unique(signed(h[new]), return_counts=True))
            if len(held) > 8:
                held = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["term", "n"])
                    held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["term", "n"])


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with spans replaced by their kind, and those to remove gone. Where spans overlap they make one, of the first's kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], "" if kind == "remove" else f"<{kind}>"]
        at = e
    return "".join([*out, text[at:]])


def _disclosing(docs: DataFrame, got: DataFrame, support: int, generalise: float, remove: float) -> DataFrame | None:
    """text_hash, added: the spans of disclosing terms of the texts that have any; None if no entity is in enough texts."""
    # rows by text first: a text that many rows hold is one row after that
    held_by = got.select("text_hash", F.explode("entities").alias("entity")).groupBy("text_hash", "entity").agg(F.count("*").alias("copies"))
    entity = held_by.groupBy("entity").agg(F.sum("copies").alias("df_e"), F.count("*").alias("texts")).filter(F.col("texts") >= support).select("entity", "df_e")
    often = materialise(held_by.join(entity, "entity"), "entities")
    if often.isEmpty():
        return None
    wanted = often.select("text_hash").distinct()
    texts = materialise(docs.select("text_hash", "text").join(wanted, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text")), "texts")
    groups = near_duplicate_groups(texts, id_col="text_hash", shingle=SHINGLE, percent=PERCENT).select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("group"))
    often = often.join(groups, "text_hash")
    enough = often.groupBy("entity").agg(F.count_distinct("group").alias("groups")).filter(F.col("groups") >= support).select("entity")
    often = materialise(often.join(enough, "entity"), "entities")
    if often.isEmpty():
        return None
    total = docs.count()
    terms = texts.join(often.select("text_hash").distinct(), "text_hash", "left_semi").mapInArrow(_terms, "text_hash long, terms array<struct<term:long,start:int,end:int>>")
    terms = materialise(terms.select("text_hash", F.explode("terms").alias("x")).select("text_hash", "x.*"), "terms")
    df = docs.select("text").mapInArrow(_document_frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("df_t"))
    # a term commoner than this reaches the ratio with no entity, not even in all of the entity's documents
    most = often.filter(F.col("df_e") < total).agg(F.max("df_e")).first()[0] or 1
    df = df.filter(F.col("df_t") <= most**generalise * total ** (1 - generalise) * 1.000001)
    df = materialise(df.join(terms.select("term").distinct(), "term", "left_semi"), "frequency")
    held = terms.select("text_hash", "term").distinct()
    hot = hot_keys(df, "term", "df_t", total)
    near = salted_join(held, df, "term", hot, F.col("text_hash")).join(often.filter(F.col("df_e") < total), "text_hash")
    # even in all documents of the entity a commoner term would not reach the ratio
    ratio = lambda both: 1 - F.log2(both / F.col("df_t")) / F.log2(F.col("df_e") / F.lit(total))
    near = near.filter(ratio(F.least("df_e", "df_t")) >= generalise)
    pair = near.groupBy("entity", "term", "df_e", "df_t").agg(F.sum("copies").alias("df_et"), F.count_distinct("group").alias("groups")).filter(F.col("groups") >= support)
    told = pair.withColumn("ratio", ratio(F.col("df_et"))).filter(F.col("ratio") >= generalise).select("entity", "term", F.when(F.col("ratio") >= remove, "remove").otherwise("general").alias("kind"))
    told = often.select("text_hash", "entity").join(told, "entity").groupBy("text_hash", "term").agg(F.max("kind").alias("kind"))
    return terms.join(told, ["text_hash", "term"]).groupBy("text_hash").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))


def _found(digest: bool):
    """mapInArrow over (doc_id, added, text): each row's spans and sanitised text (with digest its sha256)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(iter([whole])):
                out: dict[str, list] = {k: [] for k in (*KINDS[:4], "sha", "spans", "all", "clean")}
                for added, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    base = base_spans(text or "")
                    every = [*base, *((x["kind"], x["start"], x["end"]) for x in added or [])]
                    for k in KINDS[:4]:
                        out[k].append(sum(b[0] == k for b in base))
                    out["sha"].append(hashlib.sha256(joined(base, KINDS).encode()).hexdigest())
                    out["spans"].append(joined(every, KINDS))
                    out["all"].append([{"kind": x[0], "start": x[1], "end": x[2]} for x in every])
                    clean = sanitised(text or "", [x[:3] for x in every])
                    out["clean"].append(hashlib.sha256(clean.encode("utf-8", "surrogatepass")).hexdigest() if digest else clean)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [span, pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=["doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", "spans", "all_spans", "sanitised"])

    return run


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    all_spans (array of kind, start, end) and sanitised_text; with digest sanitised_sha256 in place of the text."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = materialise(docs.select("text_hash", "text").mapInArrow(_entities, "text_hash long, entities array<long>"), "personal")
    added = _disclosing(docs, got, support, generalise, remove)
    if added is None:
        rows = docs.withColumn("added", F.lit(None).cast(ADDED))
    else:
        rows = docs.join(materialise(added, "disclosing"), "text_hash", "left")
    last = "sanitised_sha256" if digest else "sanitised_text"
    found = rows.select("doc_id", "added", "text").mapInArrow(_found(digest), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, all_spans {ADDED}, sanitised string")
    return found.withColumnRenamed("sanitised", last)
