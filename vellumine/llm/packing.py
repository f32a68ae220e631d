"""Packing token sequences to a fixed length by the harmonic rule.

Method: pieces of a document have lengths ``capacity // k``, the reciprocal classes: a document gives whole sequences as long as it
can, and what is left gives the longest class length that fits, again and again (two or three pieces, seldom more than
four). A bin of class k holds exactly k pieces, so it is full but for ``capacity % k`` tokens, which for classes down
to the square root of the capacity is less than 2 percent. Each worker fills the bins of its classes by
itself, with a counter a class. The pieces of its last, partly filled bins are numbered class by class over all workers and
fill bins in the same way; what then is left, fewer than k pieces of each class k, is bounded by the capacity alone and is
packed by first fit, longest first.

A tokenizer file that parts texts into words before anything else is asked for each distinct word once; ids are then put together
by Arrow's dictionary of words. Other files encode whole texts.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellumine.llm import units
from vellumine.llm.arrow import bounded_batches
from vellumine.llm.ranks import ranked
from vellumine.session import cut, materialized, spread

CAPACITY = 4096
#: Words of a generation whose ids a worker keeps, for two generations, and the characters of such a word at most; others are encoded again.
KEPT_WORDS, KEPT_CHARS = 1 << 18, 64
#: Sequence numbers of bins that workers fill together, and of the last ones; a worker's own begin with its number.
_MERGED_BINS, _LAST_BINS = 1 << 61, 1 << 62

# The parts of a tokenizer file that parts texts into words, none of which holds white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Where such a text can be cut: beside white space, and between ASCII letters and other ASCII characters but
# for those of contractions and special tokens. Nothing else composes with, or reads, what stands across such a place.
_SPACE, _LETTER, _OTHER, _KEPT = 0, 1, 2, 3
_CLASSES = np.full(256, _KEPT, np.uint8)
_CLASSES[0x21:0x7F] = _OTHER
_CLASSES[list(b" \t\n\v\f\r")] = _SPACE
_CLASSES[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASSES[list(b"'<|>")] = _KEPT
_BEGINS = np.zeros((4, 4), bool)
_BEGINS[_SPACE, 1:] = _BEGINS[1:, _SPACE] = True
_BEGINS[_LETTER, _OTHER] = _BEGINS[_OTHER, _LETTER] = True
PARTS = units.Rule(_CLASSES, _BEGINS)


def _by_words(spec: dict) -> bool:
    """Whether ids of a text are those of its parts, one after the other."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": WORD_PATTERN} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    rest = all(s.get("type") == "ByteLevel" and s.get("add_prefix_space") is False and s.get("use_regex") is False for s in steps[1:])
    norm = (spec.get("normalizer") or {}).get("normalizers", [])
    plain = all(s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " ") for s in norm)
    added = all(set(t["content"]) <= set("abcdefghijklmnopqrstuvwxyz<|>") and t["content"][0] == "<" and t["content"][-1] == ">" and not t.get("single_word") for t in spec.get("added_tokens") or [])
    return split and rest and plain and added and spec.get("post_processor") is None


@functools.cache
def _library(path: str) -> tuple[Callable[[list[str]], list[list[int]]], Callable[[str], list[int]] | None]:
    """Ids of texts, and of one word of small ASCII letters if the file parts texts into words: such a word passes all steps
    before the merges unchanged, so these alone are run."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    model = tokenizer.model
    by_words = _by_words(json.loads(tokenizer.to_str()))
    return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], (lambda word: [t.id for t in model.tokenize(word)]) if by_words else None


_kept: dict[str, list[dict[str, array]]] = {}


def _words_ids(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, one word after the other, and how many each has; from the worker's memory or the library."""
    texts_ids, word_ids = _library(path)
    young, old = _kept.setdefault(path, [{}, {}])
    out: list[array | None] = []
    others: list[int] = []
    for word in words:
        plain = word.isascii() and word.isalpha()
        name = word.lower() if plain else word
        ids = young.get(name)
        if ids is None:
            ids = old.get(name)
            if ids is None and plain:
                ids = array("I", word_ids(name))
            if ids is None:
                others.append(len(out))
            elif len(name) <= KEPT_CHARS:
                young[name] = ids
        out.append(ids)
    for i, ids in zip(others, texts_ids([words[i] for i in others]) if others else (), strict=True):
        out[i] = array("I", ids)
        if len(words[i]) <= KEPT_CHARS:
            young[words[i]] = out[i]
    if len(young) > KEPT_WORDS:  # words of this generation and the one before stay
        _kept[path] = [{}, young]
    return np.frombuffer(b"".join(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out))


def token_ids(texts: pa.Array, path: str, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (null: empty), one text after the other, each with the id ``end`` behind it, and where each begins and the last ends."""
    encode, by_word = _library(path)
    tail = np.array([] if end is None else [end], np.uint32)
    if by_word is None:
        found = [np.concatenate([np.array(x, np.uint32), tail]) for t in texts for x in encode([t.as_py() or ""])]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])
    data, offsets = units.utf8_buffers(texts)
    begins = np.flatnonzero(PARTS.starts(data, offsets))
    parts = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    solid = _CLASSES[data[begins]] != _SPACE if len(begins) else np.zeros(0, bool)
    coded = parts.filter(pa.array(solid)).dictionary_encode()
    flat, sizes = _words_ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), path)
    which = coded.indices.to_numpy(zero_copy_only=False)
    n = sizes[which]
    ends = np.cumsum(n)  # of each part's ids among those of all parts
    # parts before the end of each text, so ids before it
    before = np.searchsorted(begins[solid], offsets)
    total = np.concatenate([[0], ends])[before]
    limits = total + np.arange(len(offsets)) * len(tail)
    out = np.full(limits[-1], 0 if end is None else end, np.uint32)
    if total[-1]:
        from_ = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - n), n)
        from_ += np.arange(total[-1])
        ids = flat[from_]
        if len(tail):
            own = np.ones(limits[-1], bool)
            own[limits[1:] - 1] = False
            out[own] = ids
        else:
            out = ids
    return out, limits


def class_of(left: np.ndarray, capacity: int) -> np.ndarray:
    """The class k, from 1, of the longest length ``capacity // k`` that is at most ``left`` (at least 1)."""
    return np.where(left >= capacity, 1, capacity // (np.minimum(left, capacity) + 1) + 1)


def pieces_of(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, class) of all pieces of documents of some lengths, in order of document and start."""
    whole = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), whole)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
    found = [(doc, start, np.full(len(doc), capacity), np.ones(len(doc), np.int64))]
    at = whole * capacity
    live = np.flatnonzero(at < lengths)
    while len(live):
        kind = class_of(lengths[live] - at[live], capacity)
        size = capacity // kind
        found.append((live, at[live].copy(), size, kind))
        at[live] += size
        live = live[at[live] < lengths[live]]
    doc, start, length, kind = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order], kind[order]


_PIECES = ("start", "length", "ids_crc32", "doc_tokens", "_class", "sequence_id", "offset")


def _cut_pieces(df: DataFrame, path: str, text: str, key: str, end: int | None, capacity: int, with_ids: bool) -> DataFrame:
    """Pieces of each row with their class; those that fill a bin of their worker have a sequence_id and an offset."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    fields = [rows.schema["_key"], *[T.StructField(c, T.LongType()) for c in _PIECES]] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    schema = T.StructType(fields)

    def pieces(batch: pa.RecordBatch) -> pa.Table:
        ids, limits = token_ids(batch.column("_text"), path, end)
        doc, start, length, kind = pieces_of(np.diff(limits), capacity)
        raw, at = ids.astype("<u4", copy=False), limits[doc] + start
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        none = pa.nulls(len(doc), pa.int64())
        columns = [batch.column("_key").take(pa.array(doc)), *[pa.array(x, pa.int64()) for x in (start, length, crc, np.diff(limits)[doc], kind)], none, none]
        if with_ids:  # pieces stand one behind the other
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, limits[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.table(columns, names=[f.name for f in fields])

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bins of one worker; what has not filled one waits, fewer than k pieces of each class k."""
        sequence, waiting = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            table = pieces(batch)
            table = table if waiting is None else pa.concat_tables([waiting, table])
            kind = table.column("_class").to_numpy()
            order = np.argsort(kind, kind="stable")
            kinds, first, n = np.unique(kind[order], return_index=True, return_counts=True)
            number = np.arange(len(kind)) - np.repeat(first, n)
            bins = n // kinds
            full = number < np.repeat(bins * kinds, n)
            own, each = order[full], np.repeat(kinds, n)[full]
            made = table.take(pa.array(own))
            ids = sequence + np.repeat(np.cumsum(bins) - bins, n)[full] + number[full] // each
            sequence += int(bins.sum())
            made = made.set_column(6, "sequence_id", pa.array(ids, pa.int64())).set_column(7, "offset", pa.array(number[full] % each * (capacity // each), pa.int64()))
            waiting = table.take(pa.array(order[~full])).combine_chunks()
            yield from made.combine_chunks().to_batches()
        if waiting is not None:
            yield from waiting.to_batches()

    return rows.mapInArrow(worked, schema)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, longest first; equal lengths in their order."""
    free: list[int] = []
    out = [(0, 0)] * len(lengths)
    begin, last = 0, None
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if n != last:  # what was too full for a length may fit a shorter one
            begin, last = 0, n
        while begin < len(free) and free[begin] < n:
            begin += 1
        if begin == len(free):
            free.append(capacity)
        out[i] = (begin, capacity - free[begin])
        free[begin] -= n
    return out


def _last_bins(left: DataFrame, capacity: int) -> DataFrame:
    """``left`` with sequence_id and offset, in one task: it has fewer than k pieces of each class k."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), arrow)
        placed = first_fit(table.column("length").to_pylist(), capacity)
        table = table.append_column("sequence_id", pa.array([_LAST_BINS + b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        yield from table.combine_chunks().to_batches()

    arrow = to_arrow_schema(left.schema)
    schema = T.StructType([*left.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return left.repartition(1).mapInArrow(fit, schema)


def packed(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", end: int | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all texts with their places: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ``ids`` if asked for.

    A document is its ids by the tokenizer file at ``path`` (every executor has it there) without special tokens, then the id ``end``
    if given; null and empty texts are that id alone, or no piece. Every id lies in exactly one piece; ``ids_crc32`` is of the
    piece's ids as little-endian unsigned 32-bit integers, ``doc_tokens`` counts the document's ids. Pieces of a sequence stand one
    behind the other from 0 and hold ``capacity`` ids together at most. Null and repeated keys are documents like
    others. Other columns are left out; an empty table has no rows. Pieces are written to the shared folder, so
    a lost executor doesn't move them.
    """
    worked = materialized(_cut_pieces(spread(df), path, text, key, end, capacity, with_ids), "pieces")
    left = worked.where("sequence_id IS NULL").select("*", F.xxhash64("_key", "start", "ids_crc32").alias("_hash"))
    by_class = F.broadcast(left.groupBy("_class").agg(F.count("*").alias("_total")))  # of two times the capacity's root classes at most
    numbered = cut(ranked(left, "_class", "_hash", "_hash", "length", "_number", "_sum").join(by_class, "_class"))
    whole = F.col("_number") < F.col("_total") - F.col("_total") % F.col("_class")
    bin_, slot = F.expr("_number div _class"), F.col("_number") % F.col("_class")
    merged = numbered.where(whole).withColumn("sequence_id", F.lit(_MERGED_BINS) + F.shiftleft("_class", 40) + bin_).withColumn("offset", slot * F.col("length"))
    last = _last_bins(numbered.where(~whole).drop("sequence_id", "offset", "_hash", "_number", "_sum", "_total"), capacity)
    columns = [F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return worked.where("sequence_id IS NOT NULL").select(*columns).unionAll(merged.select(*columns)).unionAll(last.select(*columns))


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids, limits) of ``packed`` pieces with ids: the ids of each sequence and where its pieces begin.

    ``ids`` is padded with ``pad`` to ``capacity``, unless the sequence has a power of two of them. A sequence holds no more pieces than ids, so
    what meets is bounded.
    """
    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda p: p["ids"]))
    out = held.select("sequence_id", F.size(ids).cast("long").alias("n_ids"), ids.alias("ids"), F.transform("p", lambda p: p["offset"]).alias("limits"))
    whole = F.bit_count("n_ids") == 1
    padding = F.array_repeat(F.lit(pad), F.when(whole, 0).otherwise(F.lit(capacity) - F.col("n_ids")).cast("int"))
    return out.withColumn("ids", F.concat("ids", padding))
