"""Streaming analogue of page-by-page ingest (an extension): a landing folder of result blocks to a table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumine.operators.ingest import append_batch, articles_a
from vellumine.schemas import RESULT_BLOCKS, schema
from vellumine.sources.readers import persisted


def ingest_folder(spark: SparkSession, folder: str, table: str, checkpoint: str, max_results: int | None = None) -> StreamingQuery:
    """Read Parquet files of result blocks as they land, append unseen articles to ``table``.

    Each micro-batch is de-duplicated against what other batches brought and has a folder of its own in the table, by the
    name of its checkpoint and its number; a batch that is run again replaces that folder, so every row, also
    one without a URL, stands there once. ``max_results`` caps a micro-batch; by default every block counts, since files
    once read are not read again.
    """
    writer = "w" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        # a run of this batch that failed half way is no reason to leave its rows out
        held = persisted(batch.sparkSession, table, but=(writer, batch_id))
        append_batch(articles_a(batch, held, F.current_timestamp(), max_results), table, writer, batch_id)

    blocks = spark.readStream.schema(schema(RESULT_BLOCKS)).parquet(folder)
    return blocks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_in_window(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """A stream's rows without those that repeat a ``key`` within ``delay`` of its first row's ``time``.

    State is one row a key and goes once the watermark (the greatest time of earlier batches less ``delay``) has passed, so it is bounded by the
    keys of that span and not by the stream. A row older than the watermark is too late: its key may have been forgotten, so
    it is left out, and the query's progress counts it as dropped by the watermark. Rows without a key or a time are
    no repeats of anything: all of them pass, and none is held in state.
    """
    timed = F.col(key).isNotNull() & F.col(time).isNotNull()
    once = rows.where(timed).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return once.unionByName(rows.where(~timed))


def deduplicate_folder(spark: SparkSession, folder: str, table: str, checkpoint: str, kinds: str, key: str, time: str, delay: str, files: int = 1000) -> StreamingQuery:
    """Read Parquet files of columns ``kinds`` as they land and append the first row of each ``key`` to ``table``.

    Unlike ``ingest_folder`` no batch reads the table: the keys of the last ``delay`` are the stream's state. ``files`` land in a batch at
    most; the rest waits for the next one. A batch that is run again replaces its folder.
    """
    writer = "w" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, table, writer, batch_id)

    landed = spark.readStream.schema(kinds).option("maxFilesPerTrigger", files).parquet(folder)
    stream = first_in_window(landed, key, time, delay).writeStream.outputMode("append").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
