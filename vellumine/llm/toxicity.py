"""Toxicity by compression distance: two trained zstandard dictionaries and window compression lengths.

One dictionary is trained by zstandard on ordinary text, the other on toxic text. A window of words is
compressed with the first alone and with both; what the second saves, in bytes, is the window's
distance. Thresholds on distances are calibrated on texts that trained neither dictionary, and a
document's distances give a calibrated probability.

A toxic text is ordinary but for a few words, so a dictionary trained on whole toxic texts is one of
ordinary text again. The trainer is therefore given the passages of toxic texts that tell: runs of words
with a gram, or pair of words, that is far more frequent among toxic texts than among ordinary ones.
Both dictionaries and every window end with one anchor: a window then always has a match, so
neither length falls back to raw storage, which would hide a short match.

Fitting reads a bounded sample of the labelled rows. Fitting and scoring read every byte of every text they read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.arrow import bounded_batches, utf8
from vellumine.session import materialized

#: Bounds of the fitting sample: rows of label 0 and 1. Their texts are read whole.
FIT_ROWS = (4000, 2000)
#: Bytes of a sample that the ordinary dictionary's trainer is given, and of the texts that one call of a trainer holds.
PIECE_BYTES, TRAINING_BYTES = 4 << 10, 16 << 20
#: Words in a window, and words from one window to the next.
WINDOW, STEP = 6, 5
#: Bytes of the parts of words, with their boundaries, whose shares among toxic and ordinary texts are held together.
GRAMS = (5, 6, 8, 10)
#: Most bytes of a dictionary, and its trainer's bytes of a segment and of a match.
ORDINARY, TOXIC = (16000, 200, 8), (4000, 24, 6)
#: Words of a telling passage that make one sample at most.
PASSAGE_WORDS = 16
ANCHOR = b"|~anchor~of~window~|"
#: Counts that a task holds before it passes them on.
MOST_HELD = 500_000
#: Words longer than the first are read as pieces of that size that overlap by the second, so a window's bytes are bounded and no byte is lost.
LONGEST_WORD, OVERLAP = 256, 32
#: Savings are counted by level below this; ordinary windows that may reach the threshold of a clear one.
LEVELS, FALSE_SHARE = 24, 0.001

# Fixed value: the recent offsets 1, 4 and 8 that end a zstandard dictionary's header, before its content.
_HEADER_END = b"\1\0\0\0\4\0\0\0\x08\0\0\0"
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    clear: int  # bytes that a clear window saves at least
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


# --- words and windows --------------------------------------------------------------------


def _words(text: bytes, size: int = 256 << 10) -> Iterator[list[bytes]]:
    """The words of a text, from about ``size`` bytes at a time; no word is cut by that."""
    begin = 0
    while begin < len(text):
        end = len(text)
        if end - begin > size and (space := _SPACE.search(text, begin + size)):
            end = space.end()
        out: list[bytes] = []
        for word in text[begin:end].lower().split():
            if len(word) <= LONGEST_WORD:
                out.append(word)
            else:
                out += [word[i : i + LONGEST_WORD] for i in range(0, len(word) - OVERLAP, LONGEST_WORD - OVERLAP)]
        yield out
        begin = end


def _windows(text: bytes, most: int = 4000) -> Iterator[list[bytes]]:
    """The windows of a text, on one grid over all its words, ``most`` at a time."""
    held: list[bytes] = []
    first = True
    for found in _words(text):
        held += found
        n = max((len(held) - WINDOW) // STEP + 1, 0)
        for k in range(0, n, most):
            yield [b" " + b" ".join(held[i : i + WINDOW]) + b" " + ANCHOR for i in range(k * STEP, min(k + most, n) * STEP, STEP)]
        first = first and not n
        held = held[n * STEP :]
    # words that no full window holds make one more
    if len(held) > (0 if first else WINDOW - STEP):
        yield [b" " + b" ".join(held) + b" " + ANCHOR]


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """Lists of words in which all but the first and the last two are each looked at once; empty words stand beyond the text's ends."""
    held = [b""]
    for found in _words(text):
        held += found
        yield held
        held = held[-3:]
    yield [*held, b"", b""]


def _grams(item: bytes) -> set[bytes]:
    """The grams of a word with its boundaries; a pair of words is one gram."""
    bounded = b" " + item + b" "
    return {bounded} if b" " in item else {bounded[i : i + k] for k in GRAMS for i in range(len(bounded) - k + 1)}


# --- what tells -----------------------------------------------------------------------------


def _evidence(n: int, m: int, a: int, b: int) -> float:
    """Log-likelihood ratio of n of a toxic and m of b ordinary words against equal shares."""
    share = (n + m) / (a + b)
    return n * math.log(n / (a * share)) + (m * math.log(m / (b * share)) if m else 0.0)


def _of_half(batches: Iterator[pa.RecordBatch], half: set[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """(label, h, text) of the sample's rows whose label and hash are in ``half``."""
    for batch in batches:
        for label, h, text in zip(*(batch.column(c) for c in ("label", "h", "text")), strict=True):
            if (label.as_py(), h.as_py()) in half:
                yield label.as_py(), h.as_py(), text.as_py()


def _counted(batches: Iterator[pa.RecordBatch], half: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(item, toxic, ordinary): how many texts of each label hold the word or pair of words. Each counts once for a text."""
    counts: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
    for label, _, text in _of_half(batches, half):
        held: set[bytes] = set()
        last: list[bytes] = []
        for found in _words(text):
            held.update(found)
            held.update(map(b" ".join, zip([*last, *found], [*last, *found][1:], strict=False)))
            last = found[-1:] or last
        counts[label].update(held)
        if len(counts[0]) + len(counts[1]) > MOST_HELD:
            yield _count_batch("item", *counts)
            counts = (Counter(), Counter())
    yield _count_batch("item", *counts)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, ordinary): grams count by the words that hold them."""
    counts: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
    for batch in batches:
        for item, n, m in zip(*(batch.column(c).to_pylist() for c in ("item", "toxic", "ordinary")), strict=True):
            for g in _grams(item):
                if n:
                    counts[1][g] += n
                if m:
                    counts[0][g] += m
            if len(counts[0]) + len(counts[1]) > MOST_HELD:
                yield _count_batch("gram", *counts)
                counts = (Counter(), Counter())
    yield _count_batch("gram", *counts)


def _count_batch(name: str, ordinary: Counter[bytes], toxic: Counter[bytes]) -> pa.RecordBatch:
    keys = list(ordinary.keys() | toxic.keys())
    number = lambda counts: pa.array([counts[k] for k in keys], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), number(toxic), number(ordinary)], [name, "toxic", "ordinary"])


class _Told:
    """Which of ``grams`` a word or a pair of words holds, remembered for the words met last."""

    def __init__(self, grams: set[bytes]):
        self.grams, self.known = grams, {}
        self.pairs = any(b" " in g[1:-1] for g in grams)

    def of(self, item: bytes) -> set[bytes]:
        if item not in self.known:
            if len(self.known) > MOST_HELD:
                self.known.clear()
            self.known[item] = _grams(item) & self.grams if item else set()
        return self.known[item]

    def of_pair(self, a: bytes, b: bytes) -> set[bytes]:
        return {g} & self.grams if self.pairs and a and b and (g := b" " + a + b" " + b + b" ") else set()


def _surroundings(batches: Iterator[pa.RecordBatch], half: set[tuple[int, int]], grams: set[bytes]) -> Iterator[pa.RecordBatch]:
    """(gram, around): the words before and after each place in toxic texts that holds a gram of ``grams``."""
    told = _Told(grams)
    out: set[tuple[bytes, bytes]] = set()
    for label, _, text in _of_half(batches, half):
        for x in _stretches(text) if label == 1 else ():
            for i in range(1, len(x) - 2):
                out.update((g, x[i - 1] + b" " + x[i + 1]) for g in told.of(x[i]))
                out.update((g, x[i - 1] + b" " + x[i + 2]) for g in told.of_pair(x[i], x[i + 1]))
            if len(out) > MOST_HELD:
                yield _pairs_batch(out)
                out = set()
    yield _pairs_batch(out)


def _pairs_batch(pairs: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    held = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in held], pa.binary()) for k in (0, 1)], ["gram", "around"])


def _passages(batches: Iterator[pa.RecordBatch], half: set[tuple[int, int]], grams: set[bytes]) -> Iterator[pa.RecordBatch]:
    """(h, n, piece): the runs of telling words of toxic texts, numbered within their text."""
    told = _Told(grams)
    for label, h, text in _of_half(batches, half):
        if label != 1:
            continue
        out: list[bytes] = []
        run: list[bytes] = []
        for x in _stretches(text):
            for i in range(1, len(x) - 2):
                tells = told.of(x[i]) or told.of_pair(x[i], x[i + 1]) or told.of_pair(x[i - 1], x[i])
                if tells:
                    run.append(x[i])
                if run and (not tells or len(run) == PASSAGE_WORDS):
                    out.append(b" " + b" ".join(run) + b" ")
                    run = []
        if run:
            out.append(b" " + b" ".join(run) + b" ")
        if out:
            yield _pieces_batch(h, out)


def _ordinary_pieces(batches: Iterator[pa.RecordBatch], half: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(h, n, piece): whole ordinary texts of the half, in pieces."""
    for label, h, text in _of_half(batches, half):
        if label == 0 and text:
            yield _pieces_batch(h, [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)])


def _pieces_batch(h: int, pieces: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.binary())], ["h", "n", "piece"])


# --- dictionaries ---------------------------------------------------------------------------


def _trained(samples: list[bytes], size: int, segment: int, match: int) -> bytes:
    """Content of the dictionary that zstandard trains on ``samples``; of too few for the trainer, the distinct samples themselves."""
    try:
        made = zstandard.train_dictionary(size + 256, samples, k=segment, d=match).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(dict.fromkeys(samples))[:size]
    return made[made.index(_HEADER_END) + len(_HEADER_END) :][-size:]


def _trainings(batches: Iterator[pa.RecordBatch], settings: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """A dictionary of each TRAINING_BYTES of samples."""
    pieces, held = [], 0
    for batch in batches:
        for piece in batch.column(0).to_pylist():
            pieces.append(piece)
            held += len(piece)
            if held >= TRAINING_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([_trained(pieces, *settings)], pa.binary())], ["content"])
                pieces, held = [], 0
    if pieces:
        yield pa.RecordBatch.from_arrays([pa.array([_trained(pieces, *settings)], pa.binary())], ["content"])


def _dictionary(pieces: DataFrame, settings: tuple[int, int, int]) -> bytes:
    """The dictionary of (h, n, piece), trained in one task that holds TRAINING_BYTES at a time; the driver gets dictionaries only.

    Pieces are made on all cores; only they, not the texts, move to that task.
    """
    ordered = pieces.repartition(1).sortWithinPartitions("h", "n", "piece").select("piece")
    made = [bytes(r["content"]) for r in ordered.mapInArrow(lambda bs: _trainings(bs, settings), "content binary").collect()]
    if len(made) < 2:
        return made[0] if made else b""
    return _trained([content[i : i + 64] for content in made for i in range(0, len(content), 64)], *settings)


def _telling(sample: DataFrame, half: set[tuple[int, int]]) -> set[bytes]:
    """Grams far more frequent among the toxic texts of the half than among the ordinary ones."""
    number = "toxic long, ordinary long"
    both = lambda df, name: df.groupBy(name).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    items = materialized(both(sample.mapInArrow(lambda bs: _counted(bs, half), f"item binary, {number}"), "item"), "toxicity-words")
    total = items.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("a"), F.coalesce(F.sum("ordinary"), F.lit(0)).alias("b")).first()
    a, b = total["a"] + 1, total["b"] + 1
    grams = materialized(both(items.mapInArrow(_gram_counts, f"gram binary, {number}"), "gram").where("toxic > 0"), "toxicity-grams")
    surely = math.log(grams.count() + 1) + 3  # few grams pass by chance, however many there are
    n, m = F.col("toxic"), F.col("ordinary")
    share = (n + m) / (a + b)
    evidence = n * F.log(n / (a * share)) + F.when(m > 0, m * F.log(m / (b * share))).otherwise(0.0)
    alone = n * F.log((a + b) / F.lit(float(a)))
    ratio = F.log((n + 0.5) / a) - F.log((m + 0.5) / b)
    told = {bytes(r["gram"]): (r["toxic"], r["ordinary"]) for r in grams.where((alone > surely) & (ratio > 3) & (evidence > surely)).collect()}
    if not told:
        return set()
    # Copies of one text, or of a passage, prove no more than one: what counts is in how many surroundings a gram stands.
    known = set(told)
    around = sample.mapInArrow(lambda bs: _surroundings(bs, half, known), "gram binary, around binary").distinct().groupBy("gram").count()
    places = {bytes(r["gram"]): r["count"] for r in around.collect()}
    return {g for g, (n, m) in told.items() if (k := min(places.get(g, 0), n)) and _evidence(k, m, a, b) > surely}


@functools.lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, window_log=17, hash_log=14, chain_log=16, search_log=6, target_length=32,
        write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    made = []
    # ordinary text stands equally far from a window in both, so that only a better match saves
    for content in (ordinary, toxic + ordinary):
        held = zstandard.ZstdCompressionDict(content.rjust(64) + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        made.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=held))
    return made[0], made[1]


def _lengths(compressor: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, compressor.multi_compress_to_buffer(windows)), dtype=np.int64, count=len(windows))


def savings(text: bytes, ordinary: bytes, toxic: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The three largest savings of a text's windows, and how many windows save each number of bytes (below 0: 0; above: the last)."""
    plain, marked = _compressors(ordinary, toxic)
    top, levels = np.zeros(3, dtype=np.int64), np.zeros(LEVELS, dtype=np.int64)
    for windows in _windows(text):
        saved = np.maximum(_lengths(plain, windows) - _lengths(marked, windows), 0)
        top = np.sort(np.concatenate([top, saved]))[::-1][:3]
        levels += np.bincount(np.minimum(saved, LEVELS - 1), minlength=LEVELS)
    return top, levels


def _features(top: np.ndarray, levels: np.ndarray, clear: int) -> list[float]:
    """The three largest savings, clear windows and what they save beyond the threshold, and the windows, the last three as logarithms."""
    over = np.maximum(np.arange(LEVELS) - clear + 1, 0)
    return [*map(float, top), math.log1p(int(levels[clear:].sum())), math.log1p(int((levels * over).sum())), math.log1p(int(levels.sum()))]


def _measured(batches: Iterator[pa.RecordBatch], half: set[tuple[int, int]], ordinary: bytes, toxic: bytes) -> Iterator[pa.RecordBatch]:
    """(label, x): the three largest savings and the levels of the sample's rows outside ``half``."""
    for batch in batches:
        for label, h, text in zip(*(batch.column(c) for c in ("label", "h", "text")), strict=True):
            if (label.as_py(), h.as_py()) not in half:
                x = np.concatenate(savings(text.as_py(), ordinary, toxic))
                yield pa.RecordBatch.from_arrays([pa.array([label.as_py()], pa.int32()), pa.array([x.tolist()], pa.list_(pa.int64()))], ["label", "x"])


# --- the model ------------------------------------------------------------------------------


def _calibrated(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression of rows that stand ``n`` times each, by Newton steps with a small ridge."""
    mean = np.average(x, axis=0, weights=n)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=n)) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.full(len(w), 1.0)
        ridge[-1] = 0.01
        step = np.linalg.solve((z * (n * (p * (1 - p) + 1e-9))[:, None]).T @ z + np.diag(ridge), z.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows: tuple[int, int] = FIT_ROWS) -> ToxicityModel:
    """Learn from ``documents`` that ``labels`` (key, label) marks 0 or 1. Null labels, keys and texts are left out.

    Of label 0 and 1 about ``rows`` rows at most are read, those with the smallest hash of ``key``: a
    row is taken if its hash falls below a share set by the label's count; a key that stands in several
    rows brings all of them. These few keys are broadcast, so no text is shuffled; the taken rows, with
    whole texts, are written to the shared folder, and executors count, train and measure. The driver
    gets telling grams, dictionaries and distinct measurements. Half the keys make the dictionaries, the other
    half the calibration. Without both labels in that half every score is the share of label 1.
    """
    bounded_batches(documents.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(key)).alias("h"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    reach = lambda k: math.floor(min(1.0, rows[k] / max(counts.get(k, 0), 1)) * (1 << 62))
    part = F.col("h").bitwiseAND(F.lit((1 << 62) - 1))
    taken = known.where(part < F.when(F.col("label") == 1, F.lit(reach(1))).otherwise(F.lit(reach(0)))).distinct()
    texts = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.encode(text, "UTF-8").alias("text"))
    sample = materialized(texts.join(F.broadcast(taken), "key").select("label", "h", "text"), "toxicity-sample")
    marks = sorted((r["label"], r["h"], r["count"]) for r in sample.groupBy("label", "h").count().collect())
    # rows of one key are copies for the model: all of them go to one half
    half = {mark for k in (0, 1) for mark in [(m, h) for m, h, _ in marks if m == k][::2]}
    grams = _telling(sample, half)
    ordinary = _dictionary(sample.mapInArrow(lambda bs: _ordinary_pieces(bs, half), _PIECES), ORDINARY)
    toxic = _dictionary(sample.mapInArrow(lambda bs: _passages(bs, half, grams), _PIECES), TOXIC) if grams else b""
    rest = sample.mapInArrow(lambda bs: _measured(bs, half, ordinary, toxic), "label int, x array<long>").groupBy("label", "x").count()
    # sums in one order, so scores do not hang on the tasks'
    found = sorted((r["label"], r["x"], r["count"]) for r in rest.collect())
    size = [sum(n for k, _, n in marks if k == label) for label in (0, 1)]
    if len({k for k, _, _ in found}) < 2:  # nothing to learn from: every score is the prior
        share = min(max(size[1] / max(sum(size), 1), 1e-3), 1 - 1e-3)
        flat = (0.0,) * 6
        return ToxicityModel(ordinary, toxic, 1, flat, (1.0,) * 6, flat, math.log(share / (1 - share)))
    y, n = np.array([k for k, _, _ in found], dtype=float), np.array([c for _, _, c in found], dtype=float)
    x = np.array([v for _, v, _ in found])
    usual = (x[:, 3:] * n[:, None])[y == 0].sum(axis=0)
    over = usual[::-1].cumsum()[::-1]
    clear = int(max(np.argmax(over <= FALSE_SHARE * max(over[0], 1)), 1)) if (over <= FALSE_SHARE * max(over[0], 1)).any() else LEVELS - 1
    mean, scale, weights, bias = _calibrated(np.array([_features(v[:3], v[3:], clear) for v in x]), y, n)
    # The sample holds the labels at other shares than the table; the bias puts that right.
    table = [max(counts.get(k, 0), 1) for k in (0, 1)]
    bias += math.log(table[1] / table[0]) - math.log(max(size[1], 1) / max(size[0], 1))
    return ToxicityModel(ordinary, toxic, clear, tuple(mean), tuple(scale), tuple(weights), bias)


_PIECES = "h long, n long, piece binary"


def scores(texts: list[bytes | None], model: ToxicityModel) -> np.ndarray:
    """The probability of label 1 of each text; null counts as empty."""
    x = [_features(*savings(t or b"", model.ordinary, model.toxic), model.clear) for t in texts]
    z = ((np.array(x).reshape(len(texts), -1) - np.array(model.mean)) / np.array(model.scale)) @ np.array(model.weights) + model.bias if texts else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def with_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 in ``score``; a column of that name is replaced.

    Null texts score as empty, equal texts score equally. Map only.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores(utf8(pa.array(batch, type=pa.string())), model))

    return df.withColumn(score, scored(F.col(text)))


def drop_toxic(df: DataFrame, model: ToxicityModel, most: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``df`` that score below ``most``, all columns kept."""
    name = "_score"
    while name in df.columns:
        name += "_"
    scored = with_toxicity(df, model, text, name)
    return scored.where(F.col(name) < most).select(*df.columns)
