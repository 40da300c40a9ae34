"""Mixing sources to target weights by Poisson replication.

Method. A source with weight w of all and n of N documents has a mean rate of
w * N / n copies of each document. A document's count inverts the Poisson
distribution of that mean at a uniform number hashed from the seed and its id; it
is repeated that often, and the copies are shuffled globally by another hash. Equal
seeds give equal mixtures, on any cluster and after any failure.

Scale. One aggregation by source, then one pass and one exchange by a random key,
even whatever the sources' sizes. The distribution tables, a few dozen numbers a
source, are broadcast if there are at most BROADCAST sources, else joined.

Edge cases. A null source is a source of its own. Sources without a weight, or of
weight 0 or null, are left out; if no weight is above 0 the result is empty. Weights need not sum to one. A null id
is hashed as the empty string. Rows that repeat an id get equal counts. Other columns
pass through; copy, shuffle_key and names that begin with nw_ are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import refuse

BROADCAST = 20_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of md5 of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """rates (nw_source, nw_rate) with nw_cdf, the cumulative distribution up to where it is one."""
    j = F.explode(F.sequence(F.lit(0), F.ceil(F.col("nw_rate") + 12 * F.sqrt("nw_rate") + 30).cast("int")))
    w = Window.partitionBy("nw_source").orderBy("j")
    rows = rates.select("nw_source", "nw_rate", j.alias("j")).withColumn("lf", F.sum(F.log(F.greatest(F.col("j"), F.lit(1)).cast("double"))).over(w))
    rows = rows.withColumn("p", F.exp(F.col("j") * F.log("nw_rate") - F.col("nw_rate") - F.col("lf")))
    rows = rows.withColumn("c", F.sum("p").over(w))
    return rows.groupBy("nw_source").agg(F.array_sort(F.collect_list("c")).alias("nw_cdf"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, power: float = 0.5, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs repeated and shuffled, with copy (from 1) and shuffle_key.

    weights: source, weight. Without them a source weighs as its number of documents to
    the power given."""
    refuse(docs, "copy", "shuffle_key")
    sizes = docs.groupBy(F.col(source_col).alias("nw_source")).agg(F.count("*").cast("double").alias("nw_n"))
    if weights is None:
        target = sizes.withColumn("nw_w", F.pow("nw_n", F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("nw_given")).agg(F.max("weight").cast("double").alias("nw_w"))
        target = sizes.join(given, F.col("nw_source").eqNullSafe(F.col("nw_given"))).drop("nw_given").filter("nw_w > 0")
    total = target.agg(F.sum("nw_n").alias("nw_total"), F.sum("nw_w").alias("nw_all"))
    rates = target.crossJoin(F.broadcast(total)).select("nw_source", (F.col("nw_w") / F.col("nw_all") * F.col("nw_total") / F.col("nw_n")).alias("nw_rate"))
    tables = poisson_tables(rates)
    if sizes.count() <= BROADCAST:
        tables = F.broadcast(tables)
    dealt = docs.join(tables, F.col(source_col).eqNullSafe(F.col("nw_source"))).drop("nw_source")
    u = uniform(seed, F.col(id_col))
    dealt = dealt.withColumn("nw_k", F.size(F.filter("nw_cdf", lambda c: c <= u))).drop("nw_cdf").filter("nw_k > 0")
    copies = dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("nw_k")))).drop("nw_k")
    key = F.md5(F.concat_ws("|", F.lit(f"shuffle {seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy")))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
