"""Language identification by multilingual mixture inference.

A document is cut into windows of words. Each window has a likelihood under each language, from byte
n-grams; expectation-maximisation finds the proportions of languages that explain a document's
windows best. Languages are dropped, the smallest first, as long as the likelihood penalised by
the number of languages grows, so the result is a set of languages with proportions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.arrow import by_bytes, bounded_batches, utf8

#: Bound of the fitting sample: rows of each language, about. Their texts are read whole.
FIT_ROWS = 2000
#: n-grams are hashed into 2**TABLE_BITS places, or fewer where the table of all languages would hold more bytes than MODEL_BYTES.
TABLE_BITS, MODEL_BYTES, GRAM = 17, 32 << 20, 4
WINDOW = 6
ROUNDS = 12
#: Windows of n-grams overlap, so their likelihoods are taken to this power.
TEMPER = 0.5
_SCAN_BYTES = 1 << 19
#: Likelihoods of n-grams that are gathered at a time.
_GATHERED = 1 << 21
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logs: np.ndarray  # (places, languages), float32
    prior: np.ndarray


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x21), 0x7F]] = 32
#: Digits and ASCII punctuation tell nothing of a language.
_FOLD[[b for b in range(0x21, 0x7F) if not chr(b).isalpha()]] = 32


def _grams(joined: np.ndarray, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of the n-grams that end at each byte, and which of them count.

    Counted are those whose last byte or the one before it is of a word, so that a word's ends count
    and runs of space don't.
    """
    b = joined.astype(np.uint32)
    code = b.copy()
    for k in range(1, GRAM):
        code[k:] = code[k:] + (b[:-k] << np.uint32(8 * k))
    place = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    counted = joined != 32
    counted[1:] |= joined[:-1] != 32
    return place, counted


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer((b" " * GRAM).join([b"", *texts, b""]), dtype=np.uint8)
    begin = GRAM + np.concatenate([[0], np.cumsum([len(t) + GRAM for t in texts])]).astype(np.int64)
    return _FOLD[raw], begin


def _slices(text: bytes) -> Iterator[tuple[int, int]]:
    """Begin and end of parts of about _SCAN_BYTES of a text that each begin with a window's first word, so that windows are those of the whole."""
    begin, size = 0, _SCAN_BYTES
    while len(text) - begin > size:
        folded = _FOLD[np.frombuffer(text, np.uint8, size, begin)]
        starts = np.flatnonzero((folded != 32) & np.concatenate([[True], folded[:-1] == 32]))
        last = (len(starts) - 1) // WINDOW * WINDOW
        if last <= 0:  # words so long that no window ends here
            size += _SCAN_BYTES
            continue
        yield begin, begin + int(starts[last])
        begin, size = begin + int(starts[last]), _SCAN_BYTES
    yield begin, len(text)


def _joined_slice(text: bytes, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``_joined`` of one part of a text, behind the bytes before it."""
    raw = (b" " * GRAM + text[max(begin - GRAM, 0) : begin])[-GRAM:] + text[begin:end] + b" " * GRAM
    return _FOLD[np.frombuffer(raw, dtype=np.uint8)], np.array([GRAM, len(raw)], dtype=np.int64)


def _runs(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in runs of about _SCAN_BYTES, long ones in slices: the first text's index, folded bytes, and begins of texts in them."""
    for first, run in by_bytes(texts, _SCAN_BYTES):
        if len(run) == 1 and len(run[0]) > _SCAN_BYTES:
            for begin, end in _slices(run[0]):
                yield first, *_joined_slice(run[0], begin, end)
        else:
            yield first, *_joined(run)


def fit(documents: DataFrame, language: str = "lang", text: str = "text", key: str = "doc_id", rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from rows with a language and a text; others are left out.

    Of each language about ``rows`` rows at most are read, whole, those whose hash of ``key`` falls below a
    share set by the language's count; rows of one key are taken together. Tasks count n-grams and return their
    counts by language and place. Any number of languages can be learnt: the table narrows to MODEL_BYTES.
    Without such rows every text is ``und``.
    """
    bounded_batches(documents.sparkSession)
    known = documents.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).cast("string").alias("language"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h"))
    counts = {r["language"]: r["n"] for r in known.groupBy("language").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel((UNKNOWN,), np.zeros((1 << TABLE_BITS, 1), dtype=np.float32), np.ones(1))
    names = tuple(sorted(counts))
    bits = min(TABLE_BITS, max((MODEL_BYTES // (4 * len(names))).bit_length() - 1, 1))
    shares = documents.sparkSession.createDataFrame([(n, i, int(min(1.0, rows / counts[n]) * (1 << 62))) for i, n in enumerate(names)], "language string, number int, share long")
    taken = known.join(F.broadcast(shares), "language").where(F.col("h").bitwiseAND(F.lit((1 << 62) - 1)) < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column(0).to_pylist()
            for first, joined, begin in _runs(utf8(batch.column(1))):
                place, counted = _grams(joined, bits)
                for i in range(len(begin) - 1):
                    part = slice(begin[i], begin[i + 1])
                    own = np.bincount(place[part][counted[part]], minlength=1 << bits)
                    total[of[first + i]] = total[of[first + i]] + own if of[first + i] in total else own
        for number, sums in total.items():
            held = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), number), pa.int32()), pa.array(held, pa.int32()), pa.array(sums[held])], names=["language", "place", "n"])

    sums = taken.select("number", "text").mapInArrow(count, "language int, place int, n long").groupBy("language", "place").agg(F.sum("n").alias("n"))
    table = np.zeros((1 << bits, len(names)), dtype=np.float64)
    found = sums.toPandas()  # no more rows than the table has cells
    table[found["place"], found["language"]] = found["n"]
    smooth = table + 0.05
    logs = np.log(smooth / smooth.sum(axis=0)) * TEMPER
    n = np.array([counts[x] for x in names], dtype=float)
    return LanguageModel(names, logs.astype(np.float32), n / n.sum())


def _windows(texts: list[bytes | None], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of windows, one text after the other, and each text's offsets into them."""
    found, counts = [np.zeros((0, logs.shape[1]))], np.zeros(len(texts), dtype=np.int64)
    for first, joined, begin in _runs(texts):
        of, n = _run_windows(joined, begin, logs)
        found.append(of)
        counts[first : first + len(n)] += n
    return np.concatenate(found), np.concatenate([[0], np.cumsum(counts)])


def _run_windows(joined: np.ndarray, begin: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of the windows of a run, and how many each text has."""
    place, counted = _grams(joined, len(logs).bit_length() - 1)
    starts = np.flatnonzero((joined[1:] != 32) & (joined[:-1] == 32)) + 1  # of words
    first = np.searchsorted(starts, begin)
    words = np.diff(first)
    n = -(-words // WINDOW)
    offsets = np.concatenate([[0], np.cumsum(n)])
    at = starts[(np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)) * WINDOW + np.repeat(first[:-1], n)]
    out = np.zeros((len(at), logs.shape[1]))
    if len(at):
        used = np.flatnonzero(counted[at[0] :]) + at[0]
        edge = np.append(np.searchsorted(used, at), len(used))
        most = max(_GATHERED // logs.shape[1], 1)
        a = 0
        while a < len(at):  # as many windows as gather the bound, one at least
            b = max(int(np.searchsorted(edge, edge[a] + most, "right")) - 1, a + 1)
            out[a:b] = np.add.reduceat(logs[place[used[edge[a] : edge[b]]]], edge[a:b] - edge[a], axis=0, dtype=np.float64)
            a = b
    return out, n


def _em(like: np.ndarray, owner: np.ndarray, n: np.ndarray, start: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods (without windows' maxima) of documents, from likelihoods of windows."""
    share = start
    for _ in range(ROUNDS):
        joint = like * share[owner]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, heads, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log((like * share[owner]).sum(axis=1)), heads)


def mixtures(texts: list[bytes | None], model: LanguageModel) -> np.ndarray:
    """Proportions of languages of each text, zero for languages that aren't in it; all zero without words."""
    out = np.zeros((len(texts), len(model.languages)))
    logs, offsets = _windows(texts, model.logs)
    n = np.diff(offsets)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    n = n[full].astype(float)
    heads = offsets[:-1][full]
    owner = np.repeat(np.arange(len(full)), np.diff(offsets)[full])
    like = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60))
    allowed = np.ones((len(full), len(model.languages)))
    share, fit_ = _em(like, owner, n, np.broadcast_to(model.prior, allowed.shape).copy(), heads)
    penalty = 0.5 * np.log(n + 1) + 1
    live = np.arange(len(full))
    for _ in range(len(model.languages) - 1):
        # drop each live document's smallest language, and keep that where the penalised likelihood grows
        keep = np.isin(owner, live)
        local = np.searchsorted(live, owner[keep])
        counts = n[live]
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        least = np.where(allowed[live] > 0, share[live], np.inf).argmin(axis=1)
        fewer = share[live].copy()
        fewer[np.arange(len(live)), least] = 0
        fewer = np.where(allowed[live] > 0, np.maximum(fewer, 1e-9), 0)
        fewer[np.arange(len(live)), least] = 0
        fewer /= fewer.sum(axis=1, keepdims=True)
        new_share, new_fit = _em(like[keep], local, counts, fewer, begins)
        better = new_fit + penalty[live] >= fit_[live]
        winners = live[better]
        share[winners], fit_[winners] = new_share[better], new_fit[better]
        allowed[winners, least[better]] = 0
        live = winners[allowed[winners].sum(axis=1) > 1]
        if not len(live):
            break
    out[full] = share * (allowed > 0)
    return out


def with_language(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``languages`` (names and proportions of the set, largest first).

    lang_pred is the language with the largest proportion and ``score`` that proportion; of equal ones the first by
    name. A null text and one without a letter are ``und`` with score 0 and no languages; a text whose letters fit no
    word counts as the language with the largest prior. Rows that repeat get equal values; columns of ``df`` with
    these names are replaced. Map only: the model travels to the tasks.
    """
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, languages string")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of = held.value
            values = batch.to_list()
            parts = [mixtures(run, of) for _, run in by_bytes(utf8(pa.array(values, type=pa.string())), _SCAN_BYTES)]
            share = np.concatenate(parts) if parts else np.zeros((0, len(of.languages)))
            empty = share.sum(axis=1) == 0
            share[empty] = of.prior
            lettered = np.array([v is not None and _LETTER.search(v) is not None for v in values], dtype=bool)
            best = share.argmax(axis=1)
            if of.languages == (UNKNOWN,):
                lettered[:] = False
            order = np.argsort(-share, axis=1, kind="stable")
            sets = [",".join(f"{of.languages[k]}:{share[i, k]:.3f}" for k in order[i] if share[i, k] > 0) if lettered[i] else "" for i in range(len(values))]
            yield pd.DataFrame({"lang_pred": np.where(lettered, np.array(of.languages, dtype=object)[best], UNKNOWN), "score": np.where(lettered, share[np.arange(len(values)), best], 0.0), "languages": sets})

    found: Column = predicted(F.col(text))
    own = [c for c in df.columns if c not in ("lang_pred", "score", "languages")]
    made = df.select(F.struct(*own).alias("_own"), found.alias("_made"))
    return made.select("_own.*", "_made.*")
