"""Units of many texts at once, on Arrow's UTF-8 buffers: byte classes, boundaries of adjacent bytes, counts that begin anew with each text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string column, and where each value begins and the last one ends. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if places is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    places = np.frombuffer(places, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[places[0] : places[-1]], places - places[0]


@dataclass(frozen=True)
class Rule:
    """Where units begin: a class for each byte, and for each pair of adjacent classes whether a unit begins between them."""

    classes: np.ndarray
    begins: np.ndarray

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each byte. Every text that isn't empty begins one."""
        if not len(data):
            return np.zeros(0, bool)
        kind = self.classes[data]
        out = np.empty(len(data), bool)
        np.take(self.begins.ravel(), kind[:-1] * self.begins.shape[0] + kind[1:], out=out[1:], mode="clip")
        out[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return out


def _rule(of: dict[int, str | bytes | range], pairs: list[tuple[int, int]]) -> Rule:
    classes = np.zeros(256, np.uint8)
    for kind, values in of.items():
        classes[list(values if not isinstance(values, str) else values.encode())] = kind
    begins = np.zeros((len(of) + 1, len(of) + 1), bool)
    for a, b in pairs:
        begins[a, b] = True
    return Rule(classes, begins)


#: Code points; words with the white space behind them; lines with their ends.
CHARACTERS = _rule({1: range(0x80, 0xC0)}, [(0, 0), (1, 0)])
WORDS = _rule({1: " \t\n\v\f\r"}, [(1, 0)])
LINES = _rule({1: "\n"}, [(1, 0), (1, 1)])


def counts(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running counts of units over all texts, the count before each text, and the units of each text."""
    running = np.cumsum(starts, dtype=np.int32)
    ends = np.where(offsets > 0, running[np.maximum(offsets - 1, 0)], 0).astype(np.int64) if len(running) else np.zeros(len(offsets), np.int64)
    return running, ends[:-1], np.diff(ends)


def places(running: np.ndarray, before: np.ndarray, n: np.ndarray, offsets: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The byte at which unit number ``unit`` of each text begins; the text's end for its number of units."""
    at = np.searchsorted(running, (before + unit + 1).astype(running.dtype))
    return np.where(unit < n, at, offsets[1:])
