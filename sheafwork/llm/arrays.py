"""Text columns as arrays: bytes or code points of whole batches, with the rows' offsets.

What the Arrow-based operators share.  Nothing here keeps state between batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are taken together up to this many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, width)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:
        lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
        if not np.array_equal(lengths, np.diff(offsets)):
            parts = [flat[s : s + n] for s, n in zip(offsets, lengths) if n]
            flat = np.concatenate(parts) if parts else np.empty(0, np.uint8)
            return flat, np.concatenate(([0], np.cumsum(lengths)))
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, last row + 1, bytes, offsets from 0) of each chunk of a column."""
    data, offsets = utf8(column)
    for low, high in chunks(offsets, limit):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


@lru_cache(maxsize=2)
def _powers(size: int, base: int) -> np.ndarray:
    powers = np.full(size, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


def _table(size: int, base: int) -> np.ndarray:
    rounded = 1 << max(16, int(size).bit_length())
    if rounded > 1 << 23:
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        return np.cumprod(powers)
    return _powers(rounded, base)[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Slices:
    """64-bit hashes of any slices of one array, from running sums of a rolling hash."""

    def __init__(self, data: np.ndarray):
        size = len(data) + 1
        self._inverse = _table(size, _INVERSE)
        self._sums = np.zeros(size, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(size, _BASE)[:-1], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; equal slices have equal hashes wherever they are."""
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all slices of one width, in order of their start."""
        count = max(0, len(self._sums) - width)
        return mix((self._sums[width:] - self._sums[:count]) * self._inverse[:count])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return first + np.arange(total)


def row_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row whose range holds each position."""
    return np.searchsorted(offsets, positions, "right") - 1


def strings(values, kind=pa.string()) -> pa.Array:
    return pa.array(values, kind)
