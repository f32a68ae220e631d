"""Words of many texts at once: byte classes, 64-bit word hashes and shingle hashes, in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8: its powers have the longest period modulo 2**64
_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) + _U(seed & _MASK)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUES = _splitmix(256, 11)
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_STEPS = _splitmix(64, 23) | _U(1)


def _table(separators: str | bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Word bytes of two rules: anything but ASCII white space; ASCII digits, letters and all above ASCII.
NOT_SPACE = _table(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


#: Bytes that are split and hashed together. A longer text goes through in slices, so a text costs little besides its words.
SLICE = 1 << 19


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(SLICE + 2, _BASE & _MASK, dtype=_U)
    up[0] = 1
    down = np.full(SLICE + 2, pow(_BASE, -1, 1 << 64), dtype=_U)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Words:
    """Words of a run of texts. ``hashes`` and ``spans`` are in order; text i has words offsets[i]..offsets[i+1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def _segments(text: bytes, word_bytes: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """Begin and end of slices of a text that cut no word, and whether a slice is one word longer than SLICE."""
    begin = 0
    while len(text) - begin > SLICE:
        gaps = np.flatnonzero(~word_bytes[np.frombuffer(text, np.uint8, SLICE, begin)])
        if len(gaps):
            end = begin + int(gaps[-1]) + 1
            yield begin, end, False
        else:
            end = begin + SLICE
            while end < len(text):
                part = np.frombuffer(text, np.uint8, min(SLICE, len(text) - end), end)
                gaps = np.flatnonzero(~word_bytes[part])
                end += int(gaps[0]) if len(gaps) else len(part)
                if len(gaps):
                    break
            yield begin, end, True
        begin = end
    yield begin, len(text), False


def _long_word(text: bytes, begin: int, end: int) -> np.ndarray:
    total, up = 0, _powers()[0]
    for i in range(begin, end, SLICE):
        part = np.frombuffer(text, np.uint8, min(SLICE, end - i), i)
        total += int((_VALUES[part] * up[: len(part)]).sum(dtype=_U)) * pow(_BASE, i - begin, 1 << 64)
    return mix(np.array([total & _MASK], dtype=_U))


def _split(parts: list[bytes], word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of ``parts``, which are parted by one byte each and hold SLICE bytes together."""
    joined = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    inside = word_bytes[joined]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # the joined bytes end with a separator
    up, down = _powers()
    sums = np.zeros(len(joined) + 1, dtype=_U)
    np.cumsum(_VALUES[joined] * up[: len(joined)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def words(texts: list[bytes], word_bytes: np.ndarray) -> Words:
    """Split texts into runs of ``word_bytes`` with A-Z lowered, and hash each run.

    Starts and ends count bytes of the texts joined with one byte between them. A word's hash is the sum of
    byte values times powers of an odd base, by differences of one running sum, so the cost is a
    few vector passes over the bytes.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[bytes] = []
    size = first = begin = 0  # bytes held, place of the first of them, place of the text

    def flush() -> None:
        nonlocal held, size
        if held:
            hashes, starts, ends = _split(held, word_bytes)
            found.append((hashes, starts + first, ends + first))
        held, size = [], 0

    places = [0]
    for text in texts:
        if len(text) <= SLICE:
            if size + len(text) + 1 > SLICE:
                flush()
            if not held:
                first = begin
            held.append(text)
            size += len(text) + 1
        else:
            flush()
            for at, end, one in _segments(text, word_bytes):
                if one:
                    found.append((_long_word(text, at, end), np.array([begin + at]), np.array([begin + end])))
                else:
                    held, first = [text[at:end]], begin + at
                    flush()
        begin += len(text) + 1
        places.append(begin)
    flush()
    if not found:
        return Words(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(hashes, starts, ends, np.searchsorted(starts, np.array(places, dtype=np.int64)))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and each text's offsets into them.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    h, counts = found.hashes, found.counts()
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - found.offsets[:-1], n)
    out = np.full(len(at), size, dtype=_U)
    padded = np.concatenate([h, np.zeros(size, dtype=_U)])
    for k in range(size):
        out += padded[at + k] * _STEPS[k]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = h[found.offsets[i] : found.offsets[i + 1]]
        out[offsets[i]] = (own * _STEPS[: len(own)]).sum(dtype=_U) + _U(len(own))
    return mix(out), offsets
