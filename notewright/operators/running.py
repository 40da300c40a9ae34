"""Running sums and row positions over a whole table, without a task that holds it.

Sums go over ranges of the order column whose limits are quantiles of it, whatever its scale: totals by range, sums of the
totals over the ranges (at most RANGES rows), and sums within each range. Values that are equal are in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def limits(rows: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """Ascending limits that cut the rows' values into about equal parts, from a mergeable sketch; NaN counts as the greatest."""
    x = F.col(column).cast("double")
    found = rows.agg(F.percentile_approx(F.when(~F.isnan(x), x), [i / ranges for i in range(1, ranges)], 50 * ranges)).first()[0] or []
    return sorted(set(found))


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts are at most the value, by bisection in compiled code; null for null."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= cuts[mid], half(mid + 1, hi)).otherwise(half(lo, mid))

    return F.when(value.isNotNull(), half(0, len(cuts)))


def running(rows: DataFrame, order: str, sums: dict[str, str], *, keys: list[str] = (), descending: bool = False, ranges: int = RANGES, cuts: list[float] | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """rows (distinct in keys and order) with running sums, of this row and those before it in order, by keys.

    sums: name -> column; totals: name -> column, its sum over the whole key. cuts: limits of ranges, if they are known."""
    keys, totals = list(keys), totals or {}
    cuts = limits(rows, order, ranges) if cuts is None else cuts
    placed = rows.withColumn("r_range", F.coalesce(range_of(F.col(order).cast("double"), cuts), F.lit(-1)))
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    of = {c: f"r_s{i}" for i, c in enumerate(dict.fromkeys([*sums.values(), *totals.values()]))}
    by = placed.groupBy(*keys, "r_range").agg(*[F.sum(c).alias(n) for c, n in of.items()])
    before = Window.partitionBy(*keys).orderBy(way("r_range")).rowsBetween(Window.unboundedPreceding, -1)
    start = {name: f"r_b{i}" for i, name in enumerate(sums)}
    by = by.select(*[F.col(k).alias(f"r_k{i}") for i, k in enumerate(keys)], F.col("r_range").alias("r_own"), *[F.coalesce(F.sum(of[c]).over(before), F.lit(0)).alias(start[n]) for n, c in sums.items()], *[F.sum(of[c]).over(Window.partitionBy(*keys)).alias(n) for n, c in totals.items()])
    on = F.col("r_range") == F.col("r_own")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"r_k{i}"))
    # without keys there are no more rows of totals than ranges
    joined = placed.join(by if keys else F.broadcast(by), on)
    within = Window.partitionBy(*keys, "r_range").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.select(*rows.columns, *[(F.col(start[n]) + F.sum(c).over(within)).alias(n) for n, c in sums.items()], *totals)
    return out


def with_position(rows: DataFrame, name: str = "position", *, by_row: bool = True) -> DataFrame:
    """rows of files, as read, with their position from 0: files in order of their paths, rows as they stand in them.

    by_row: the format tells a row's number in its file (Parquet). Else (text, JSON lines, CSV without line breaks in
    fields) a task's rows are numbered in the order in which it reads each block of a file. One row for each file or block is gathered to add up
    what lies before it; rows themselves are not shuffled."""
    if by_row:
        read = rows.select("*", F.col("_metadata.file_path").alias("p_file"), F.lit(0).cast("long").alias("p_block"), F.col("_metadata.row_index").alias("p_row"))
    else:
        read = rows.select("*", F.col("_metadata.file_path").alias("p_file"), F.col("_metadata.file_block_start").alias("p_block"), F.monotonically_increasing_id().alias("p_row"))
    size = read.groupBy("p_file", "p_block").agg(F.min("p_row").alias("p_first"), F.count("*").alias("p_n"))
    before = F.sum("p_n").over(Window.orderBy("p_file", "p_block").rowsBetween(Window.unboundedPreceding, -1))
    size = size.select(F.col("p_file").alias("p_f"), F.col("p_block").alias("p_b"), F.coalesce(before, F.lit(0)).alias("p_before"), F.lit(0).cast("long").alias("p_first") if by_row else F.col("p_first"))
    out = read.join(size, (F.col("p_file") == F.col("p_f")) & (F.col("p_block") == F.col("p_b")))
    return out.select(*rows.columns, (F.col("p_before") + F.col("p_row") - F.col("p_first")).alias(name))


def zipped(left: DataFrame, right: DataFrame, position: str = "position", *, longest: bool = False) -> DataFrame:
    """Rows of two tables side by side by position, as far as the shorter goes, or the longer; names must differ but for position."""
    if clash := set(left.columns) & set(right.columns) - {position}:
        raise ValueError(f"columns {sorted(clash)} are in both tables")
    return left.join(right, position, "full" if longest else "inner")
