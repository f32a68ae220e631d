"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut

#: Rows of a task that reads edges and groups nothing by them.
TASK_ROWS = 1 << 16


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, read in tasks of about TASK_ROWS, four a core at least.

    What a shuffle wrote in its partitions, however few rows they have, would be as many tasks again, each of which the driver sends, hears of
    and keeps a record of. Four a core leave enough parts into which adaptive execution can split a hot vertex.
    """
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def _least(pairs: DataFrame) -> DataFrame:
    """For each u of (u, v): the least of u and its neighbours, as (u2, least); one row a vertex, written.

    The join with ``pairs`` is then one of two plain shuffles, which adaptive execution splits where u is hot.
    """
    return cut(pairs.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("u2"), F.least("u", "w").alias("least")))


def _to_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, least) of ``pairs``."""
    return pairs.join(least, F.col("u") == F.col("u2")).drop("u2")


def _each(*edges: Column) -> Column:
    return F.explode(F.array(*edges)).alias("e")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Vertices of the undirected ``edges`` with the least vertex that each reaches: (id, component).

    Vertices without an edge to another vertex don't appear. Rounds grow with the logarithm of the
    largest component's diameter; each is two aggregations and two joins, written to the
    checkpoint folder, so none is made twice. A vertex with very many edges is combined before the shuffle, and its join
    is one that adaptive execution splits. Null vertices are ignored.
    """
    u, v = F.col(a), F.col(b)
    stars = cut(edges.where((u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = _state(stars)
    while state[0]:
        stars, most = _gathered(stars, state[0]), 2 * state[0]
        both = stars.select(_each(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).select("e.*")
        large = _to_least(both, _gathered(_least(both), most)).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = _gathered(cut(large.distinct()), most)
        least = _gathered(_least(large), most)
        # large stars that change nothing have roots alone below; where each vertex has one root, small stars change nothing either
        if _state(large) == state and least.count() == state[0]:
            break
        small = _to_least(large, least).select(_each(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v"))))
        stars = cut(small.select("e.u", "e.v").where("u != v").distinct())
        state = _state(stars)
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select(F.col("v"), F.col("v")).distinct())
