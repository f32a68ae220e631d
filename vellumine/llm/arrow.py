"""Arrow batches in pieces of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that Spark puts into one Arrow batch for a Python worker. A batch holds at
#: least one row, so a worker's need is bounded by this or by the longest single text.
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by rows and bytes; long texts then can't pile up in a worker.

    Spark has these limits by session only. A session with tighter ones keeps them.
    """
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        setting = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(setting).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(setting, str(most))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The values of a string column as bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [None] * len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def by_bytes(texts: Iterable[bytes | None], most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of ``texts`` (null: empty) of about ``most`` bytes, each with its first index."""
    first, run, held = 0, [], 0
    for i, text in enumerate(texts):
        text = text or b""
        if run and held + len(text) > most:
            yield first, run
            first, run, held = i, [], 0
        run.append(text)
        held += len(text)
    if run:
        yield first, run
