"""Fill-in-the-middle transformation of whole texts.

Method: one numpy kernel a batch, on Arrow's UTF-8 buffers. Bytes are looked up in a table of classes, a mask over adjacent
classes marks where units begin, running counts that start anew with each text number them, and one binary search in
the counts finds the cuts of all rows together. Only the pieces between cuts are then put together in their new order.

What is drawn for a row depends on its key alone: four numbers from SHA-256 of ``seed:key``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm import units
from vellumine.llm.arrow import bounded_batches

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of rows that are cut, and of those that are written suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
KINDS = {"character": units.CHARACTERS, "word": units.WORDS, "line": units.LINES}
OUT = ("n", "form", "prefix_chars", "middle_chars", "output")


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds one of the three marks."""
    out = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero(data[: max(len(data) - 2, 0)] == ord("<"))
    at = at[np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8)) & (data[at + 2] == ord(">"))]
    text = np.searchsorted(offsets, at, side="right") - 1
    out[text[at + 2 < offsets[text + 1]]] = True
    return out


def infill_batch(texts: pa.Array, draws: list[np.ndarray], rule: units.Rule, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> list[pa.Array]:
    """The columns OUT of a batch of texts (null: empty); ``draws`` has four numbers a row."""
    data, offsets = units.utf8_buffers(texts)
    running, before, n = units.counts(rule.starts(data, offsets), offsets)
    first, second = draws[0] % (n + 1), draws[1] % (n + 1)
    low, high = np.minimum(first, second), np.maximum(first, second)
    a, b = units.places(running, before, n, offsets, low), units.places(running, before, n, offsets, high)
    plain = (n == 0) | marked(data, offsets) | (draws[2] % 100 >= cut_percent)
    turned = draws[3] % 100 < suffix_first_percent
    held, pieces, sizes = memoryview(data), [], np.diff(offsets) + np.where(plain, 0, len(PREFIX) + len(SUFFIX) + len(MIDDLE))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for whole, suffix_first, x, y, u, v in zip(plain.tolist(), turned.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), a.tolist(), b.tolist(), strict=True):
        if whole:
            pieces.append(held[x:y])
        elif suffix_first:
            pieces += (s, held[v:y], p, held[x:u], m, held[u:v])
        else:
            pieces += (p, held[x:u], s, held[v:y], m, held[u:v])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    wide = ends[-1] > np.iinfo(np.int32).max
    output = (pa.LargeStringArray if wide else pa.StringArray).from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64 if wide else np.int32)), pa.py_buffer(b"".join(pieces)))
    form = pa.array(np.where(plain, 0, np.where(turned, 1, 2)), pa.int8())
    return [
        pa.array(n, pa.int64()),
        pa.array(["plain", "spm", "psm"]).take(form),
        pa.array(low, pa.int64(), mask=plain),
        pa.array(high - low, pa.int64(), mask=plain),
        output,
    ]


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers of a row; a null key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def with_infill(df: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "character", seed: str = "1", cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """``df`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``: each whole text cut in three at random units.

    Units are code points (``character``), words with the white space behind them (``word``) or lines (``line``); ``n`` counts
    them, and prefix and middle are counted in them. ``output`` is prefix, suffix and middle with a mark before each (form
    ``psm``), or suffix, prefix and middle (``spm``). Null and empty texts and those that hold a mark stay as they are (``plain``,
    counts null), as do ``100 - cut_percent`` percent of the others. Rows that repeat a key and a text have equal values.
    Columns of the new names are replaced, other columns pass through; an empty table has no rows. Map only: nothing is shuffled.
    """
    rule, own = KINDS[unit], [c for c in df.columns if c not in OUT or c == text]
    bounded_batches(df.sparkSession)
    # a struct, so that columns of df can't clash; the text goes to Python once
    drawn = df.select(F.struct(*own).alias("_own"), *[h.alias(f"_h{i}") for i, h in enumerate(draws(F.col(key), seed))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(f"_h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
            made = infill_batch(batch.column("_own").field(own.index(text)), numbers, rule, cut_percent, suffix_first_percent)
            yield pa.RecordBatch.from_arrays([batch.column("_own"), *made], names=["_own", *OUT])

    schema = T.StructType([drawn.schema["_own"], *[T.StructField(c, T.StringType() if c in ("form", "output") else T.LongType()) for c in OUT]])
    return drawn.mapInArrow(cut, schema).select(*[F.col("_own")[c].alias(c) for c in own if c not in OUT], *OUT)


def restored(output: Column, form: Column) -> Column:
    """The text from ``output`` and ``form``, in native functions.

    No mark stands in a text that was cut, and none can arise where two pieces meet, so there are exactly three. An output
    of another make gives null.
    """
    parts = F.split(output, "<[PSM]>")
    whole = F.size(parts) == 4
    order = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).when(whole, order)
