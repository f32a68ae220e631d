"""Benchmark decontamination with suffix arrays of the training text.

Documents are read in shards of bounded bytes. Each shard gets the suffix array of its words, by
doubling: the ranks of all runs of 1, 2, 4, ... words, and from them the order of all suffixes. Every
suffix of every benchmark item is looked up in it by binary search, first its words, then runs
of twice the length, as long as all of a window's runs are there; the window's interval in the array is
all its places in the shard. Longer matches narrow that interval further, down to the suffixes that share
most words with the item's. Ranks stand for words whose 64-bit hashes are equal; words inside
matches are then compared byte by byte.

Nothing is shuffled: the documents stay where they are, and the benchmark goes to them in blocks of bounded bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.arrow import bounded_batches, utf8
from vellumine.llm.words import ALNUM, Words, words
from vellumine.session import cut, materialized

#: Words of a window.
WINDOW = 10
#: UTF-8 bytes of benchmark text that one pass over the documents carries; a larger benchmark takes more passes.
BENCHMARK_BYTES = 16 << 20
#: Bytes of documents in a shard, and words of a part of a longer document.
SHARD_BYTES, PART_WORDS = 3 << 20, 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- suffix arrays --------------------------------------------------------------------------


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``key`` in order, and each value's number among them from 1."""
    distinct, rank = np.unique(key, return_inverse=True)
    return distinct, rank.astype(np.int64) + 1


class SuffixArray:
    """All suffixes of the words of some texts, in the order of their first ``depth`` words.

    ``levels[j]`` has the distinct runs of 2**j words in order, as pairs of ranks of half that length, and the
    rank of the run that begins at each word; runs that a text's end cuts short are there too, with 0 for missing halves.
    """

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, depth: int):
        self.n, self.depth = len(hashes), depth
        self.end = np.repeat(offsets[1:], np.diff(offsets))
        self.levels = [_ranked(hashes)]
        while 2 << (len(self.levels) - 1) <= depth:
            self.levels.append(_ranked(self._pair(len(self.levels) - 1, 1 << (len(self.levels) - 1))))

    def _pair(self, level: int, step: int) -> np.ndarray:
        """The ranks at each word and ``step`` words behind it as one number."""
        distinct, rank = self.levels[level]
        key = rank * np.int64(len(distinct) + 1)
        if step < self.n:
            inside = np.flatnonzero(np.arange(step, self.n) < self.end[: self.n - step])
            key[inside] += rank[inside + step]
        return key

    def key(self, size: int) -> np.ndarray:
        """A number for the first ``size`` words of each suffix, in their order: two runs that overlap make them up."""
        level = size.bit_length() - 1
        return self._pair(level, size - (1 << level)) if size > 1 << level else self.levels[level][1]

    @cached_property
    def at(self) -> np.ndarray:
        """The suffixes in order."""
        return np.argsort(self.key(self.depth), kind="stable")

    def find(self, level: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The ranks of runs of 2**level words, given by the ranks of their halves; 0 where the shard has none."""
        distinct = self.levels[level][0]
        wanted = first * np.int64(len(self.levels[level - 1][0]) + 1) + second
        place = np.minimum(np.searchsorted(distinct, wanted), len(distinct) - 1)
        return np.where((distinct[place] == wanted) & (first > 0) & (second > 0), place + 1, 0)

    def interval(self, size: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For keys of ``size`` words: the suffixes that begin with them, as begin and end in the array."""
        ordered = self.key(size)[self.at]
        return np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")

    def narrowed(self, lo: np.ndarray, hi: np.ndarray, skip: np.ndarray, level: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search within intervals whose suffixes share ``skip`` words: those whose next run of 2**level words has the rank ``wanted``."""
        return self._bound(lo, hi, skip, level, wanted, False), self._bound(lo, hi, skip, level, wanted, True)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, skip: np.ndarray, level: int, wanted: np.ndarray, after: bool) -> np.ndarray:
        lo, hi, rank = lo.copy(), hi.copy(), self.levels[level][1]
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            place = self.at[mid]
            behind = place + skip[open_]
            value = np.where(behind < self.end[place], rank[np.minimum(behind, self.n - 1)], 0)
            left = (value <= wanted[open_]) if after else (value < wanted[open_])
            lo[open_[left]] = mid[left] + 1
            hi[open_[~left]] = mid[~left]
        return lo


# --- the benchmark --------------------------------------------------------------------------


@dataclass
class Items:
    """A block of the benchmark. Windows are distinct; arrays with one entry a word count in 32 bits."""

    ids: list[str]  # distinct, sorted
    offsets: np.ndarray  # of each row's words
    rows: np.ndarray  # index of each row's id, -1: null
    word: np.ndarray  # number of each word in the vocabulary
    vocabulary: np.ndarray  # distinct hashes, in order
    spelled: np.ndarray  # bytes of the vocabulary, one word after the other
    spelled_at: np.ndarray
    starts: np.ndarray  # first word of each window, where it first stands
    sizes: np.ndarray
    held: np.ndarray  # ids of each window, one window after the other
    held_at: np.ndarray


def _spelling(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered bytes of words, one after the other, and where each begins."""
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n)])
    return _LOWER[joined[np.arange(at[-1]) - np.repeat(at[:-1] - starts, n)]], at


def _windows(counts: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and size of every window of the rows."""
    n = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[:-1][row], np.minimum(counts, window)[row]


def prepare(ids: list[str | None], texts: list[bytes | None], window: int = WINDOW) -> Items:
    """A block of benchmark rows, ready to be looked up. Raises ValueError if two of its words share a 64-bit hash."""
    texts = [t or b"" for t in texts]
    found = words(texts, ALNUM)
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    vocabulary, first, word = np.unique(found.hashes, return_index=True, return_inverse=True)
    spelled, spelled_at = _spelling(joined, found.starts[first], found.ends[first])
    names = sorted({i for i in ids if i is not None})
    number = {name: k for k, name in enumerate(names)}
    rows = np.array([-1 if i is None else number[i] for i in ids], dtype=np.int32)
    row, starts, sizes = _windows(found.counts(), found.offsets, window)
    items = Items(names, found.offsets, rows, word.astype(np.int32), vocabulary, spelled, spelled_at, starts, sizes, rows[:0], starts[:0])
    if not _spelled_alike(joined, found, np.arange(len(word)), items, word).all():
        raise ValueError("two words of the benchmark share a hash")
    # windows of one size are the same where their keys are
    array = SuffixArray(word.astype(np.uint64), found.offsets, window)
    key = np.zeros(len(starts), dtype=np.int64)
    for size in np.unique(sizes):
        own = sizes == size
        key[own] = array.key(int(size))[starts[own]]
    order = np.lexsort((rows[row], key, sizes))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
    of, held = np.cumsum(new) - 1, rows[row][order]
    named = held >= 0
    named[1:] &= new[1:] | (held[1:] != held[:-1])
    items.starts, items.sizes = starts[order][new].astype(np.int32), sizes[order][new].astype(np.int32)
    items.held, items.held_at = held[named], np.concatenate([[0], np.cumsum(np.bincount(of[named], minlength=int(new.sum())))])
    return items


def _spelled_alike(joined: np.ndarray, found: Words, place: np.ndarray, items: Items, word: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """Whether each of the words at ``place`` has the bytes of the vocabulary's ``word``; ``most`` are compared at a time."""
    if len(place) > most:
        return np.concatenate([_spelled_alike(joined, found, place[i : i + most], items, word[i : i + most]) for i in range(0, len(place), most)])
    starts, n = found.starts[place], found.ends[place] - found.starts[place]
    alike = n == (items.spelled_at[word + 1] - items.spelled_at[word])
    own = np.flatnonzero(alike)
    bytes_, at = _spelling(joined, starts[own], starts[own] + n[own])
    theirs = items.spelled[np.arange(at[-1]) - np.repeat(at[:-1] - items.spelled_at[word[own]], n[own])]
    wrong = np.concatenate([[0], np.cumsum(bytes_ != theirs)])
    alike[own] = wrong[at[1:]] == wrong[at[:-1]]
    return alike


def _within(bad: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether runs of ``n`` places from ``starts`` hold a place that is ``bad``."""
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[starts + n] > total[starts]


def _ranks(array: SuffixArray, items: Items) -> tuple[np.ndarray, list[np.ndarray]]:
    """The windows whose runs the array has at every level, and for each level the ranks of the runs that begin at each item word.

    A rank is 0 where the array has no such run or no window that is left needs it.
    """
    distinct = array.levels[0][0]
    place = np.minimum(np.searchsorted(distinct, items.vocabulary), len(distinct) - 1)
    ranks = [np.where(distinct[place] == items.vocabulary, place + 1, 0)[items.word]]
    live = np.flatnonzero(~_within(ranks[0] == 0, items.starts, items.sizes))
    for level in range(1, len(array.levels)):
        run = 1 << level
        longer = live[items.sizes[live] >= run]
        starts, n = items.starts[longer], items.sizes[longer] - run + 1
        step = np.bincount(starts, minlength=len(items.word) + 1) - np.bincount(starts + n, minlength=len(items.word) + 1)
        need = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        rank = np.zeros(len(items.word), dtype=np.int64)
        rank[need] = array.find(level, ranks[-1][need], ranks[-1][need + run // 2])
        ranks.append(rank)
        gone = longer[_within(rank == 0, starts, n)]
        live = live[~np.isin(live, gone, assume_unique=True)]
    return live, ranks


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (number, place) of the intervals."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def _looked_up(array: SuffixArray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The windows that the array has, their intervals in it, and the ranks of item runs."""
    live, ranks = _ranks(array, items)
    lo, hi = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    for size in np.unique(items.sizes[live]):
        own = np.flatnonzero(items.sizes[live] == size)
        starts, level = items.starts[live[own]], int(size).bit_length() - 1
        wanted = ranks[level][starts].astype(np.int64)
        if size > 1 << level:
            wanted = wanted * (len(array.levels[level][0]) + 1) + ranks[level][starts + size - (1 << level)]
        lo[own], hi[own] = array.interval(int(size), wanted)
    return live, lo, hi, ranks


def occurrences(found: Words, joined: np.ndarray, items: Items, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All places of windows in a shard: the first word's number in the shard, and the window.

    A shard of more than PART_WORDS words goes through in parts that overlap by a window, so that the array
    of one very long document stays bounded.
    """
    total, places, windows = len(found.hashes), [], []
    for begin in range(0, total if len(items.starts) else 0, PART_WORDS):
        end = min(begin + PART_WORDS + window - 1, total)
        offsets = np.clip(found.offsets, begin, end) - begin
        array = SuffixArray(found.hashes[begin:end], offsets, window)
        live, lo, hi, _ = _looked_up(array, items)
        which, rank = _spread(lo, hi)
        place = array.at[rank] + begin if len(rank) else rank
        first = place < begin + PART_WORDS
        places.append(place[first])
        windows.append(live[which[first]])
    place, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, windows))
    covered = np.flatnonzero(_covered(total, place, items.sizes[of]))
    word = np.searchsorted(items.vocabulary, found.hashes[covered])
    alike = _spelled_alike(joined, found, covered, items, word) if len(covered) else np.ones(0, bool)
    if not alike.all():  # other words with the hashes of the benchmark's: they match nothing
        bad = np.zeros(total, dtype=bool)
        bad[covered[~alike]] = True
        found.hashes[bad] = next(x for x in range(len(items.vocabulary) + 1) if x not in items.vocabulary)
        right = ~_within(bad, place, items.sizes[of])
        place, of = place[right], of[right]
    return place, of


def _covered(n: int, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words is inside a run of ``sizes`` words from ``place``."""
    step = np.bincount(place, minlength=n + 1) - np.bincount(place + sizes, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


# --- DataFrames -----------------------------------------------------------------------------


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[list, list[bytes | None]]]:
    """The distinct rows of the benchmark in blocks of about ``most`` bytes, each fetched by itself."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-int(total) // most) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        fetched = sorted(part.collect(), key=lambda r: (r["id"] or "", r["text"] or ""))
        yield [r["id"] for r in fetched], [None if r["text"] is None else r["text"].encode() for r in fetched]
        fetched = None


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows in shards of about SHARD_BYTES, with their texts (null: empty)."""
    held: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        begin = 0
        for i, value in enumerate(utf8(batch.column(batch.schema.get_field_index(text)))):
            value = value or b""
            if size and size + len(value) > SHARD_BYTES:
                held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches(held), texts
                held, texts, size, begin = [], [], 0, i
            texts.append(value)
            size += len(value) + 1
        held.append(batch.slice(begin))
    if texts:
        yield pa.Table.from_batches(held), texts


def _searched(texts: list[bytes], items: Items, window: int) -> tuple[Words, np.ndarray, np.ndarray]:
    found = words(texts, ALNUM)
    return found, *occurrences(found, np.frombuffer(b" ".join([*texts, b""]), np.uint8), items, window)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII digits and letters (A-Z lowered) and of all characters above ASCII. A window
    is ``window`` consecutive words of an item, or a whole shorter item that isn't empty. n_hit counts the
    document's words inside any occurrence of any window; n_items the distinct item ids with an
    occurrence; items_sha256 is of those ids as strings, sorted, joined by commas (of nothing if there
    are none). Null and empty texts have no words, null item ids are left out of the ids, rows that
    repeat are each judged, other columns are ignored. A benchmark of more than ``block_bytes`` takes several
    passes over the documents, one after the other: each is written before the next block is held; their spans then meet by document.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _blocks(benchmark, "item_id", "text", block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _pass(rows, prepare(*first, window), window, False)[0]
    parts = []
    for block in chain((first, second), blocks):
        found, held = _pass(rows, prepare(*block, window), window, True)
        # rows that repeat a key and a text have equal spans: they count as one from here on, however many they are
        found = found.groupBy("doc_id", "digest").agg(F.first("n_words").alias("n_words"), F.first("b").alias("b"), F.first("e").alias("e"), F.first("items").alias("items"), F.count("*").cast("int").alias("copies"))
        parts.append(materialized(found, "spans"))
        held.destroy()
        first = second = block = None  # the driver holds one block at a time
    met = reduce(DataFrame.unionAll, parts).groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("b", "e")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("copies").alias("copies"),
    )
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(F.greatest(acc["end"], s["e"]).alias("end"), (acc["n"] + F.greatest(s["e"] - F.greatest(acc["end"], s["b"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )
    met = met.withColumn("n_hit", covered).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return met.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_JUDGED = {"doc_id": "long", "n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}
_PARTIAL = {"doc_id": "long", "n_words": "long", "digest": "string", "b": "array<long>", "e": "array<long>", "items": "array<string>"}


def _named(of: np.ndarray, window: np.ndarray, items: Items, n: int) -> list[np.ndarray]:
    """The numbers of the ids whose windows stand in each of ``n`` texts, in order."""
    out = [items.held[:0]] * n
    pair = np.unique(of * np.int64(len(items.starts) + 1) + window)
    text, window = np.divmod(pair, len(items.starts) + 1)
    edges = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]])) if len(text) else text
    for lo, hi in zip(edges, edges[1:], strict=False):
        _, at = _spread(items.held_at[window[lo:hi]], items.held_at[window[lo:hi] + 1])
        out[text[lo]] = np.unique(items.held[at])
    return out


def _pass(rows: DataFrame, items: Items, window: int, partial: bool) -> tuple[DataFrame, Broadcast]:
    """One pass over (doc_id, text) with one block of the benchmark, and what it broadcasts; ``partial`` gives spans and ids instead of a verdict."""
    held = rows.sparkSession.sparkContext.broadcast(items)
    names = _PARTIAL if partial else _JUDGED

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        for table, texts in _shards(batches, "text"):
            found, place, which = _searched(texts, of, window)
            covered = _covered(len(found.hashes), place, of.sizes[which])
            named = _named(np.searchsorted(found.offsets, place, "right") - 1, which, of, len(texts))
            ids = [[of.ids[k] for k in x] for x in named]
            columns = [table.column("doc_id").combine_chunks(), found.counts()]
            if partial:
                columns += [[hashlib.sha256(t).hexdigest() for t in texts], *_spans(covered, found.offsets), ids]
            else:
                total = np.concatenate([[0], np.cumsum(covered)])
                hit = total[found.offsets[1:]] - total[found.offsets[:-1]]
                columns += [hit, [len(x) for x in ids], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], hit > 0]
            kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
            made = [c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, k in zip(columns, names.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=list(names))

    return rows.mapInArrow(judge, ", ".join(f"{n} {k}" for n, k in names.items())), held


def _spans(covered: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Begins and ends, within their text, of the runs of covered words."""
    before = np.concatenate([[False], covered[:-1]]) if len(covered) else covered
    edge = np.zeros(len(covered) + 1, dtype=bool)
    edge[offsets] = True
    begin = np.flatnonzero(covered & (~before | edge[:-1]))
    after = np.concatenate([covered[1:], [False]]) if len(covered) else covered
    end = np.flatnonzero(covered & (~after | edge[1:])) + 1
    at = np.searchsorted(begin, offsets)
    first = np.repeat(offsets[:-1], np.diff(at))
    return tuple(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x - first, pa.int64())) for x in (begin, end))


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The longest verbatim match of each benchmark suffix in all documents: item_id, item_word, n_words, doc_id, doc_word, byte_start, byte_end.

    One row for each word of an item from which at least ``window`` words (or the whole shorter item) stand in
    a document: how many stand there at most, and in which document, the smallest doc_id and then the first
    place if there are several. Words count from 0, bytes are those of the document's UTF-8. Suffixes without a
    match have no row; rows with the same id and text are one. The result is no larger than the benchmark.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for k, block in enumerate(_blocks(benchmark, "item_id", "text", block_bytes)):
        matches, held = _matches(rows, prepare(*block, window), window)
        parts.append(materialized(matches.withColumn("block", F.lit(k)), "matches"))
        held.destroy()
    found = reduce(DataFrame.unionAll, parts)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_word", "byte_start", "byte_end")).alias("m")
    met = found.groupBy("item_id", "block", "row", "item_word").agg(best)
    return met.select("item_id", "item_word", (-F.col("m.n")).alias("n_words"), "m.doc_id", "m.doc_word", "m.byte_start", "m.byte_end")


_MATCH = "item_id string, row long, item_word long, n_words long, doc_id long, doc_word long, byte_start long, byte_end long"


def _matches(rows: DataFrame, items: Items, window: int) -> tuple[DataFrame, Broadcast]:
    """The longest match of each suffix of ``items`` in each shard, and what is broadcast."""
    held = rows.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        row_of, start, size = _windows(np.diff(of.offsets), of.offsets, window)
        for table, texts in _shards(batches, "text"):
            found, place, _ = _searched(texts, of, window)
            if not len(place):
                continue
            # only documents with an occurrence are put in order again, now to the end of the longest item
            text_of = np.repeat(np.arange(len(texts)), found.counts())
            hit = np.unique(text_of[place])
            own = np.concatenate([np.arange(found.offsets[t], found.offsets[t + 1]) for t in hit])
            array = SuffixArray(found.hashes[own], np.concatenate([[0], np.cumsum(found.counts()[hit])]), int(np.diff(of.offsets).max()))
            lo, hi, n = _longest(array, of, start, of.offsets[1:][row_of] - start)
            live = np.flatnonzero(n >= size)
            # of several places the one in the document with the smallest id
            ids = table.column("doc_id").to_pylist()
            rank = np.empty(len(texts), dtype=np.int64)
            rank[sorted(range(len(texts)), key=lambda t: (ids[t] is None, ids[t] or 0, t))] = np.arange(len(texts))
            places = array.at.astype(np.int64)
            at = own[_least(rank[text_of[own[places]]] * len(own) + places, lo[live], hi[live]) % len(own)]
            text, row = text_of[at], row_of[live]
            begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            columns = [
                pa.array([None if k < 0 else of.ids[k] for k in of.rows[row]], pa.string()), row, start[live] - of.offsets[row], n[live],
                table.column("doc_id").combine_chunks().take(pa.array(text)), at - found.offsets[text], found.starts[at] - begin[text], found.ends[at + n[live] - 1] - begin[text],
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=[part.split()[0] for part in _MATCH.split(", ")])

    return rows.mapInArrow(find, _MATCH), held


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of ``values`` from each ``lo`` up to ``hi``, which is behind it: ranges of a power of two, level by level."""
    out = np.empty(len(lo), values.dtype)
    level_of = np.frexp((hi - lo).astype(np.float64))[1] - 1
    for level in range(int(level_of.max(initial=-1)) + 1):
        own = np.flatnonzero(level_of == level)
        out[own] = np.minimum(values[lo[own]], values[hi[own] - (1 << level)])
        values = np.minimum(values[: -(1 << level)], values[1 << level :]) if len(values) > 1 << level else values
    return out


def _longest(array: SuffixArray, items: Items, start: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For item suffixes of ``most`` words from ``start``: the interval of the array that shares most words with each, and how many."""
    distinct = array.levels[0][0]
    place = np.minimum(np.searchsorted(distinct, items.vocabulary), len(distinct) - 1)
    ranks = [np.where(distinct[place] == items.vocabulary, place + 1, 0)[items.word]]
    for level in range(1, len(array.levels)):
        behind = np.concatenate([ranks[-1][1 << (level - 1) :], np.zeros(1 << (level - 1), np.int64)])[: len(items.word)]
        ranks.append(array.find(level, ranks[-1], behind))
    lo, hi, n = np.zeros(len(start), np.int64), np.full(len(start), array.n, np.int64), np.zeros(len(start), np.int64)
    for level in range(len(array.levels) - 1, -1, -1):
        live = np.flatnonzero(n + (1 << level) <= most)
        wanted = ranks[level][start[live] + n[live]]
        live, wanted = live[wanted > 0], wanted[wanted > 0]
        a, b = array.narrowed(lo[live], hi[live], n[live], level, wanted)
        grown = live[a < b]
        lo[grown], hi[grown], n[grown] = a[a < b], b[a < b], n[grown] + (1 << level)
    return lo, hi, n


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """``documents`` without those that hold a window of the benchmark, all columns kept. Map only.

    Null and empty texts stay; rows that repeat are each judged, and equal texts alike. A benchmark of more than
    ``block_bytes`` takes a pass for each block, between which the rows left are written to the checkpoint folder.
    """
    bounded_batches(documents.sparkSession)
    cleaned = held = None
    for block in _blocks(benchmark, "item_id", "text", block_bytes):
        if held is not None:
            documents = cut(cleaned)
            held.destroy()
        cleaned, held = _cleaned(documents, prepare(*block, window), window)
    return cleaned


def _cleaned(documents: DataFrame, items: Items, window: int) -> tuple[DataFrame, Broadcast]:
    held = documents.sparkSession.sparkContext.broadcast(items)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in _shards(batches, "text"):
            found, place, _ = _searched(texts, held.value, window)
            clean = np.ones(len(texts), dtype=bool)
            clean[np.searchsorted(found.offsets, place, "right") - 1] = False
            yield from table.filter(pa.array(clean)).to_batches()

    return documents.mapInArrow(keep, documents.schema), held
