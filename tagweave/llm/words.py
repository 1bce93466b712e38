"""Words of whole Arrow text columns as 64-bit hashes, computed with numpy over their bytes.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). Texts are taken in
slices of about a megabyte, so memory stays flat however many rows a batch has; a longer text is one
slice of its own. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _BASE + _U(seed)) | _U(1)


_BYTE = constants(256, 11)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers = np.ones(1, _U), np.ones(1, _U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for slices of usual length."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    tables = []
    for base in (_BASE, _INVERSE):
        t = np.full(max(n, SLICE_BYTES + 1), base, _U)
        t[0] = 1
        tables.append(np.multiply.accumulate(t))
    if n <= 2 * SLICE_BYTES:
        _powers = tuple(tables)
    return tuple(tables)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each row's offsets into them; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    row, rows = 0, len(at) - 1
    while row < rows:
        end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


class Spans:
    """Hashes of any byte ranges of a slice, after one pass over its bytes."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        power, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, _U)
        np.cumsum(table[data] * power[: len(data)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])


@dataclass
class Words:
    """Words of the rows ``first`` up to ``last`` of a batch; row i has words bounds[i]:bounds[i+1]."""

    first: int
    last: int
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def word_slices(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Word hashes and byte ranges, slice by slice; ``lower`` folds A-Z."""
    raw, at = text_bytes(column)
    for first, last in slices(at):
        data = raw[at[first] : at[last]]
        rows = at[first : last + 1] - at[first]
        inside = ~IS_SPACE[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[rows] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | begins[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | begins[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        spans = Spans(data, _BYTE_LOWER if lower else _BYTE)
        yield Words(first, last, spans.hashes(s, e), s, e, np.searchsorted(s, rows))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; of all words if there are fewer, nothing without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    factors = constants(n, 23)
    total = np.zeros(len(words) - k + 1, _U)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * factors[i]
    return mix(total + _U(k))
