"""From raw documents to a sharded training mix, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``. In every stage rows may have null
columns, repeat, or carry further columns of any name, and tables may be empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumine.llm import decontaminate, mixing, nearcopy, order, shards, toxicity
from vellumine.session import removed, written

#: Documents at or over this score are toxic.
TOXIC = 0.5
#: Words of a shingle and similarity, in percent, of near copies.
SHINGLE, SIMILAR = 5, 80
#: Target weights of the mix by source (None: bytes to the power 0.9), bytes of a block, and the part of the weight whose sources
#: may run dry before the mix ends (1: it never ends before all rows are in it).
MIX_WEIGHTS, MIX_BLOCK, MIX_LOST = None, mixing.BLOCK_BYTES, 1.0
SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model learns from the labelled rows of ``docs``.

    Null and empty texts score as empty, so they stay as long as most documents are clean. Equal texts go together.
    Null labels and labels of other documents are ignored; without both labels every score is the share of
    toxic ones, at most 0.5 unless most labels are toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.drop_toxic(docs, model, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Documents without words and those with a null doc_id stay. Of rows that repeat a doc_id one stays, that with the
    smallest row by value.
    """
    return nearcopy.deduplicated(docs, size=SHINGLE, percent=SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten benchmark words, or a whole shorter item.

    Null and empty texts stay, equal texts go together; null and empty items match nothing.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted into the order of the mix by MIX_WEIGHTS; rows of a null source are a source of their own.

    The next stage reads that order from the files. Rows are placed one by one, so null and repeated ids change nothing. By default
    no row is left out.
    """
    return mixing.mixed(docs, MIX_WEIGHTS, block_bytes=MIX_BLOCK, lost=MIX_LOST)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, shard and slot: ranges of the mix of nearly equal bytes, each with the sources that the mix has there.

    ``docs`` is taken in the order of its files. Equal texts, null and empty ones too, share a shard, that of the first of them.
    """
    return shards.with_shards(order.with_position(docs), SHARDS, position="_position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: No stage of the five can be written in SQL: the first is a trained model over compression lengths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the ``documents`` table in ``sf_dir``. What a stage wrote goes once the next one has written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            removed(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
