"""Joins by a key that may be null in very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(rows: DataFrame, known: DataFrame, key: str, how: str) -> DataFrame:
    # Rows without a key find nothing; a number of their own deals them over all partitions instead of into one. On the other
    # side the number is a hash and no constant, which would be folded into the condition and leave the key alone to deal by.
    salt = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(key))
    return rows.withColumn("_deal", salt).join(known.where(F.col(key).isNotNull()).withColumn("_deal", F.xxhash64(key)), [key, "_deal"], how)


def left(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """A left join by ``key``; rows without a key have nulls and are spread over all partitions."""
    return _joined(rows, known, key, "left").select(*rows.columns, *[c for c in known.columns if c != key])


def without(rows: DataFrame, known: DataFrame, key: str, distinct: bool = True) -> DataFrame:
    """Rows whose ``key`` is not among those of ``known``. Rows without a key all stay, spread over all partitions.

    ``distinct`` False: keys of ``known``, a written table, are distinct already, and adaptive execution may split a frequent key.
    """
    keys = known.select(key)
    return _joined(rows, keys.distinct() if distinct else keys, key, "left_anti").select(*rows.columns)
