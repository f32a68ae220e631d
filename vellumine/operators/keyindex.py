"""A persisted index of keys (J1, S5): key files by bucket, and a Bloom filter for each block of a bucket.

Candidates ask the filters first (some 11 bits a key, read whole), so only buckets that may hold some of them are read. All of it is
column expressions; filters are bitmaps that Spark's own aggregates build and merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine import joins
from vellumine.session import cut

#: Bits of a block's bitmap (the size that ``bitmap_construct_agg`` makes), keys that a block is meant for, bits set by a key.
BLOCK_BITS, BLOCK_KEYS, HASHES = 32_768, 3_000, 7

KEYS, FILTERS, SHAPE = "keys", "filters", "shape"


def create(spark: SparkSession, path: str, expected: int, buckets: int = 256) -> None:
    """An empty index at ``path`` for about ``expected`` keys; raises if something stands there.

    With ``expected`` keys some 1 percent of absent keys pass the filters; with more keys more do, which costs reads and
    never a wrong answer. The shape stays as it is; ``rebuilt`` makes an index of another one.
    """
    if expected < 1 or buckets < 1:
        raise ValueError("an index has at least one key and one bucket")
    blocks = -(-expected // (BLOCK_KEYS * buckets))
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(blocks).alias("blocks")).write.mode("errorifexists").parquet(f"{path}/{SHAPE}")


def add(keys: DataFrame, path: str, batch: int, key: str = "url") -> None:
    """Bring the distinct keys of one numbered batch into the index; null keys are left out.

    A batch that runs again replaces itself. Its filters are written first: a batch lost between the two writes makes
    filters pass keys that the key files then deny.
    """
    placed = cut(_placed(keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct(), path))
    filters = placed.select("block", F.explode(_positions()).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    filters.write.mode("overwrite").parquet(f"{path}/{FILTERS}/batch={batch}")
    # a bucket's rows meet in few files; a key is in one bucket, and hashes fill buckets alike
    placed.select("key", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{KEYS}/batch={batch}")


def possible(keys: DataFrame, path: str) -> DataFrame:
    """(key, bucket) of those distinct ``keys`` (one column, ``key``) that the filters do not rule out."""
    spark = keys.sparkSession
    held = _read(spark, f"{path}/{FILTERS}", "block long, bits binary, batch int")
    whole = held.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    asked = _placed(keys, path).join(whole, "block")
    byte = lambda p: F.conv(F.hex(F.substring("bits", (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = lambda p: F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (p % 8 + 1).cast("int"))
    return asked.where(F.forall(_positions(), lambda p: byte(p).bitwiseAND(bit(p)) != 0)).select("key", "bucket")


def held(candidates: DataFrame, path: str, key: str = "url") -> DataFrame:
    """(key) of the distinct candidates that the index holds, exactly. Reads the buckets that may hold one, and no other."""
    spark = candidates.sparkSession
    asked = candidates.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct()
    maybe = cut(possible(asked, path))
    buckets = sorted(r["bucket"] for r in maybe.select("bucket").distinct().collect())  # at most the index's buckets
    return maybe.join(stored(spark, path, buckets), "key", "left_semi").select("key")


def stored(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """(key) of all batches in some of the index's buckets; folders of the others are not read."""
    return _read(spark, f"{path}/{KEYS}", "key string, batch int, bucket int").where(F.col("bucket").isin(buckets)).select("key")


def unseen(candidates: DataFrame, path: str, key: str = "url") -> DataFrame:
    """Candidates whose key the index does not hold; rows with a null key all stay, repeated rows too.

    Equal to the anti join with all keys of the index. A key that very many candidates share is asked for once.
    """
    found = cut(held(candidates, path, key).select(F.col("key").cast(candidates.schema[key].dataType).alias(key)))
    return joins.without(candidates, found, key, distinct=False)


def rebuilt(spark: SparkSession, path: str, to: str, expected: int, buckets: int = 256) -> None:
    """All keys of ``path`` as one batch, number 0, of a new index at ``to``: fewer files, or another shape."""
    create(spark, to, expected, buckets)
    add(_read(spark, f"{path}/{KEYS}", "key string, batch int, bucket int").select("key"), to, 0, "key")


def _placed(keys: DataFrame, path: str) -> DataFrame:
    shape = keys.sparkSession.read.parquet(f"{path}/{SHAPE}").first()
    block = F.pmod(F.xxhash64("key"), F.lit(shape["buckets"] * shape["blocks"]).cast("long"))
    return keys.withColumn("block", block).withColumn("bucket", F.floor(block / shape["blocks"]).cast("int"))


def _positions() -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col("key")), F.lit(BLOCK_BITS).cast("long")) for i in range(1, HASHES + 1)])


def _read(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).option("basePath", path).parquet(path)
