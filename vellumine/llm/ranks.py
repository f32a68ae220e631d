"""Ranks and running sums over very large groups, without a group ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells that a group is dealt into: ranges of the order key, and parts of each range by a hash. A
#: table of cells is bounded by their product for each group.
RANGES, SALTS = 256, 64


def _running(cells: DataFrame, within: list[str], order: str) -> DataFrame:
    """Sums of ``_n`` and ``_sum`` over the cells before each, as ``_first`` and ``_before``."""
    earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))


def _in_cells(df: DataFrame, group: str, key: str, tie: str | None) -> DataFrame:
    # a struct, so that a null group joins with itself
    salt = F.pmod(F.shiftright(key, 48), F.lit(256)) if tie is None else F.pmod(F.xxhash64(tie), F.lit(SALTS))
    return df.withColumn("_group", F.struct(group)).withColumn("_range", F.shiftright(key, 56)).withColumn("_salt", salt)


def counted(df: DataFrame, group: str, key: str, tie: str | None, value: str) -> DataFrame:
    """Rows and the sum of ``value`` by cell, as ``ranked`` needs them: (_group, _range, _salt, _n, _sum)."""
    return _in_cells(df, group, key, tie).groupBy("_group", "_range", "_salt").agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))


def ranked(df: DataFrame, group: str, key: str, tie: str | None, value: str, rank: str = "rank", before: str = "before", counts: DataFrame | None = None) -> DataFrame:
    """``df`` with each row's 0-based rank within ``group`` and the sum of ``value`` over rows before it.

    The order is by range of the 64-bit hash ``key``, then by a hash of ``tie``, then by key and tie. Rows are
    counted by cell (``counts``: already counted); running sums over the cells, at most RANGES * SALTS of a
    group, give each cell its offset, and only the rows of a cell are sorted together. One key with a third of
    all rows is dealt over SALTS cells by ``tie``. Without a ``tie`` keys have to be distinct, and the order is
    that of the keys; cells are then ranges alone.
    """
    by = ["_group", "_range", "_salt"]
    counts = counted(df, group, key, tie, value) if counts is None else counts
    # first the ranges of a group, then the cells of a range: no task sums over all cells of a group
    ranges = _running(counts.groupBy("_group", "_range").agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum")), ["_group"], "_range")
    cell = _running(counts, ["_group", "_range"], "_salt").select(*by, F.col("_first").alias("_f"), F.col("_before").alias("_b"))
    offsets = cell.join(ranges.select("_group", "_range", "_first", "_before"), ["_group", "_range"])
    offsets = offsets.select(*by, (F.col("_first") + F.col("_f")).alias("_first"), (F.col("_before") + F.col("_b")).alias("_before"))
    inside = Window.partitionBy(*by).orderBy(*([key] if tie is None else [key, tie]))
    own = _in_cells(df, group, key, tie).withColumn("_row", F.row_number().over(inside) - 1).withColumn("_cell_sum", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = own.join(offsets, by)
    return joined.withColumn(rank, (F.col("_first") + F.col("_row")).cast("long")).withColumn(before, (F.col("_before") + F.col("_cell_sum")).cast("long")).drop("_group", "_range", "_salt", "_row", "_cell_sum", "_first", "_before")
