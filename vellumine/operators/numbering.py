"""Row numbers over a whole table without one sorted partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import materialized

#: ``monotonically_increasing_id`` holds the partition above and the row within it below this bit.
ROW_BITS = 33


def _row() -> Column:
    return F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)


def numbered(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with ``name``, a long from 1 in the order of the columns ``order``, gapless over all rows; nulls come first.

    Ranges of the order are sorted each by itself and written; the rows before a range are the sum of a count a range, so
    only that many counts meet in one place. Rows that tie are in any order and are dealt over ranges too. A
    column of that name is replaced; other columns may have any name.
    """
    kept = [c for c in df.columns if c != name]
    made = {c: f"_c{i}" for i, c in enumerate(kept)}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [made[c] for c in order]
    # columns go by numbers, so that none clashes with what is added
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in made.items()], F.monotonically_increasing_id().alias("_tie"))
    ranged = rows.repartitionByRange(parts, *by, "_tie").sortWithinPartitions(*by)
    placed = materialized(ranged.withColumn("_id", F.monotonically_increasing_id()).drop("_tie"), "numbered").withColumn("_range", F.shiftright("_id", ROW_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    number = F.col("_first") + F.col("_id").bitwiseAND((1 << ROW_BITS) - 1) + 1
    return placed.join(F.broadcast(offsets), "_range").select(*[F.col(n).alias(c) for c, n in made.items()], number.cast("long").alias(name))


def leading(df: DataFrame, most: int, order: Sequence[str], name: str = "position") -> DataFrame:
    """The first ``most`` rows by ``order``, numbered from 1; of rows that tie at the end any are taken.

    Each task keeps its own first ``most`` rows before anything is shuffled, so a small number moves little, and a number of
    many millions meets in ranges, never in one task. Those rows are written first: finding the ranges reads them once more, and what made them
    may be dear.
    """
    row = "_row" + "".join(df.columns)  # longer than any column's name
    own = df.sortWithinPartitions(*order).withColumn(row, _row()).where(F.col(row) < most).drop(row)
    return numbered(materialized(own, "leading"), order, name).where(F.col(name) <= most)
