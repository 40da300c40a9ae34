"""MinHash near-duplicate groups by fast similarity sketching.

Method. A document is its set of distinct word shingles. The sketch has T bins:
in round i every element is hashed to a bin with value (i, hash), the bin keeps
the least; after T rounds element hashing visits bin i - T itself, so that every
coordinate fills (Dahlgaard, Knudsen and Thorup, 2017). Coordinates of equal sets
agree, and those of others agree with a probability of about their Jaccard
similarity, with concentration bounds that plain one-permutation hashing lacks.
Bands of R coordinates make candidates; candidates are confirmed on full sets;
components of confirmed links are the groups.

Scale. Equal sets are one class from the start. A bucket of any size gives one
link per member, to its least member. Only buckets that still join several
components after that are searched in full: every two blocks of its members are
compared by the product of their incidence matrices, in tasks of bounded size
(blocks by hash, of one component where it is large, so that no bucket is sorted or
numbered in one task and two blocks of one component are not compared),
which return one link for each two components they join. Nothing is collected on the driver.

Edge cases. Null or wordless text: empty set, linked with nothing. Fewer words
than a shingle: the whole sequence is one shingle. Rows that repeat a doc_id are
documents of their own. A null doc_id takes part, however many there are; if all of a
group's are null its component is null and kept is false. Other columns, clashing or not, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialise, salted_join
from .textkit import _U, mix, parts, raw_texts, sequence_hash, shingle_sets, signed

#: Bins of a sketch; the greatest probability that a pair at the threshold shares no band.
BINS, MISS = 120, 1e-6
#: Members of a block in the full search of a bucket; shingles of a matrix.
BLOCK, COLUMNS = 256, 8192


def band_rows(percent: int, bins: int = BINS, miss: float = MISS) -> int:
    """The most coordinates a band may have (5 at 85, 4 at 80)."""
    t = percent / 100
    return max(r for r in range(1, bins + 1) if r == 1 or (1 - t**r) ** (bins // r) <= miss)


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of bins coordinates per non-empty set."""
    docs = len(sets)
    out = np.full(docs * bins, np.iinfo(_U).max, _U)
    flat = np.concatenate(sets) if docs else np.zeros(0, _U)
    owner = np.repeat(np.arange(docs), [len(s) for s in sets])
    for i in range(2 * bins):
        if not len(flat):
            break
        with np.errstate(over="ignore"):
            h = mix(flat ^ mix(np.array([i + 1], _U) * _U(0x9E3779B97F4A7C15)))
        at = (h >> _U(32)) * _U(bins) >> _U(32) if i < bins else np.full(len(h), i - bins, _U)
        value = (_U(i) << _U(32)) | (h & _U(0xFFFFFFFF))
        np.minimum.at(out, owner * bins + at.astype(np.int64), value)
        open_ = (out.reshape(docs, bins) == np.iinfo(_U).max).any(axis=1)
        more = open_[owner]
        flat, owner = flat[more], owner[more]
    return out.reshape(docs, bins)


def _signatures(shingle: int, bins: int, rows: int):
    bands = bins // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=_U))
        for batch in parts(batches):
            raw = raw_texts(batch.column(1))
            step = 1000
            for a in range(0, len(raw), step):
                sets = shingle_sets(raw[a : a + step], shingle)
                n = len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                sk = sketches([sets[i] for i in full], bins)
                key = np.zeros((len(full), bands), _U)
                for j in range(rows):
                    key = mix(key * _U(0xC2B2AE3D27D4EB4F) + sk[:, j::rows][:, :bands])
                key = mix(key ^ salt)
                node: list[int | None] = [None] * n
                band: list = [None] * n
                for r, i in enumerate(full):
                    digest = sequence_hash(sets[i])
                    node[i] = (digest & (2**64 - 1)) - 2**63
                    band[i] = signed(key[r])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(band, pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "node", "n_shingles", "bands"],
                )

    return run


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 500):
            left, right = (shingle_sets(raw_texts(batch.column(i)), shingle) for i in (2, 3))
            keep = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full sets are similar enough. texts: node, text."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(shingle, percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the least node of its component.

    Alternates large-star and small-star (Kiveris et al., 2014) until nothing changes, which takes
    a number of rounds that grows with the logarithm of a component's size; each is written to the shared folder."""
    low = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = materialise(low(edges), "edges"), None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = low(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = low(large.join(least, "a").select("b", "m").toDF("a", "b").union(least.select("a", "m")))
        edges = materialise(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by matrix products of COLUMNS shingles."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float64)
    for a in range(0, len(both), COLUMNS):
        part = both[a : a + COLUMNS]

        def rows(sets, part=part):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                at = np.searchsorted(part, s)
                at[at == len(part)] = 0
                m[i, at[part[at] == s]] = 1
            return m

        out += rows(left) @ rows(right).T
    return out


def _rest_links(shingle: int, percent: int):
    """Links between two blocks of one bucket that join different components: one for each two components."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        node, label = np.asarray(table["node"]), np.asarray(table["label"])
        sets = shingle_sets(raw_texts(table["text"]), shingle)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        size = np.array([len(s) for s in sets])
        both = _common([sets[i] for i in x], [sets[i] for i in y])
        union = size[x][:, None] + size[y][None, :] - both
        i, j = np.nonzero((100 * both >= percent * union) & (label[x][:, None] != label[y][None, :]))
        i, j = x[i], y[j]
        lo, hi = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        _, first = np.unique(np.stack([lo, hi]), axis=1, return_index=True) if len(i) else (None, np.zeros(0, int))
        return pa.table({"a": node[i[first]], "b": node[j[first]]})

    return run


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bins: int = BINS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    signed_docs = docs.mapInArrow(_signatures(shingle, bins, band_rows(percent, bins)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, node long, n_shingles long, bands array<long>")
    signed_docs = materialise(signed_docs, "sketches")
    # a null id is the greatest
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    classes = signed_docs.filter("node is not null").groupBy("node").agg(F.min(row).alias("row"), F.first("bands").alias("bands"))
    classes = materialise(classes.select("node", F.col("row.doc_id").alias("least"), F.col("row.text_hash").alias("least_hash"), "bands"), "classes")
    member = classes.select("node", F.explode("bands").alias("bucket"))
    shared = materialise(member.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("size")).filter("size > 1"), "shared")
    # a bucket that very many share goes to many tasks
    hot = hot_keys(shared, "bucket", "size", classes.count() * (bins // band_rows(percent, bins)))
    member = materialise(salted_join(member, shared.select("bucket", "lead"), "bucket", hot, F.col("node")), "buckets")

    near = member.select("node").distinct().join(classes.select("node", F.col("least").alias("near_id"), "least_hash"), "node")
    texts = docs.join(near, F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("text_hash") == F.col("least_hash")))
    texts = texts.select("node", "text").mapInArrow(_own_text(shingle), "node long, text string")
    texts = materialise(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    star = member.filter("node > lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    links = materialise(confirmed(star, texts, shingle, percent), "links")
    label = materialise(components(links), "labels")

    # buckets that still join several components: search them in full, in blocks
    named = member.select("bucket", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    spread = salted_join(named, open_, "bucket", hot, F.col("node"))
    # blocks by hash, of one label where it has so many members, else of whole labels
    of_label = spread.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    few = of_label.filter(F.col("size") < BLOCK).groupBy("bucket").agg(F.ceil(F.sum("size") / F.lit(BLOCK)).alias("few"))
    sized = spread.join(of_label, ["bucket", "label"]).join(few, "bucket", "left")
    own = F.xxhash64("label", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / F.lit(BLOCK))))
    blocks = sized.withColumn("block", F.when(F.col("size") < BLOCK, F.pmod(F.xxhash64("label"), F.col("few"))).otherwise(own))
    blocks = materialise(blocks.select("bucket", "block", "node", "label"), "blocks")
    of_block = blocks.groupBy("bucket", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    other = of_block.toDF("bucket", "other", "lo2", "hi2")
    tasks = of_block.join(other, "bucket").filter("block <= other and least(lo, lo2) < greatest(hi, hi2)").select("bucket", "block", "other")
    one = blocks.join(tasks, ["bucket", "block"]).select("bucket", "block", "other", "node", "label", F.lit(0).alias("side"))
    two = blocks.withColumnRenamed("block", "other").join(tasks, ["bucket", "other"]).select("bucket", "block", "other", "node", "label", F.lit(1).alias("side"))
    sides = one.union(two).join(texts, "node")
    rest = sides.groupBy("bucket", "block", "other").applyInArrow(_rest_links(shingle, percent), "a long, b long")
    more = materialise(rest, "links")
    label = materialise(components(links.union(more)), "labels") if not more.isEmpty() else label

    group = classes.select("node", "least").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_of = group.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = group.join(least_of, "label").select("node", "component_id")
    out = signed_docs.select("doc_id", "node", "n_shingles").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _own_text(shingle: int):
    """Only rows whose text is of the class they were joined to (a doc_id may repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            node = batch.column(0).to_pylist()
            sets = shingle_sets(raw_texts(batch.column(1)), shingle)
            yield batch.filter(pa.array([(sequence_hash(s) & (2**64 - 1)) - 2**63 == n for n, s in zip(node, sets, strict=True)], pa.bool_()))

    return run
