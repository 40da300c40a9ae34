"""Reading each text once, however many rows have it.

Reports repeat: templates and normal findings come in the same words many times, and what is read from a text depends on
nothing else. Rows of equal text are brought together, read once and dealt to their rows again. That is no more
than a saving: nothing depends on all rows of a text meeting, so a text of very many rows is split over tasks, and over
groups of one batch, and is read once in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of a batch, with the batch's keys that have it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        code = coded.indices
        order = pc.sort_indices(code)
        n = pc.value_counts(pc.take(code, order)).field("counts").to_numpy()  # every code occurs, in order
        ends = pa.array([0, *n.cumsum()], pa.int32())
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(ends, batch.column(1).take(order))], names=["text", "keys"])


def by_text(rows: DataFrame, text: str) -> DataFrame:
    """Rows text, keys: an array of the other columns of rows that have this text. A text may have several rows."""
    spark = rows.sparkSession
    others = [c for c in rows.columns if c != text]
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = rows.select(F.col(text).alias("text"), F.struct(*others).alias("keys"))
    # by a hash, whose sort compares numbers; equal texts are told apart in _grouped
    met = both.hint("rebalance", n, F.col("text")).sortWithinPartitions(F.xxhash64("text"))
    schema = StructType([StructField("text", both.schema["text"].dataType), StructField("keys", ArrayType(both.schema["keys"].dataType))])
    return met.mapInArrow(_grouped, schema)


def exploded(rows: DataFrame, array: Column, name: str, keep: list[str], at: str | None = None, outer: bool = False) -> DataFrame:
    """A row of keep and name (and at, its place from 0) for each struct or text of the array, none of which is null; outer: one of nulls for an empty array.

    explode() would have its array tested for emptiness below the columns that it is made of, which makes it twice."""
    if at is None:
        rows = rows.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = rows.select(*keep, F.posexplode_outer(array).alias(at, name))
    return rows if outer else rows.filter(F.col(name).isNotNull())


def dealt(read: DataFrame) -> DataFrame:
    """What has been read from texts (rows with keys) for each of the keys."""
    return read.select(F.inline("keys"), *[c for c in read.columns if c != "keys"])
