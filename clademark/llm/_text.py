"""Whole texts as flat byte arrays: words, rolling hashes and chunks of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit integers (the splitmix64 finalizer)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random-looking number for each byte, so that byte values do not add up alike.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Hashes of any substring of a byte array from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all substrings of one width, by start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def released() -> None:
    """Give freed memory back to the system: workers are used again and again, and what one job has freed would stay theirs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, off = flat(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    released()


def table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A flag for each byte: whether it is in one of the inclusive ranges."""
    flags = np.zeros(256, bool)
    for a, b in ranges:
        flags[a : b + 1] = True
    return flags


#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~table([(0x20, 0x20), (0x09, 0x0D)])
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing.
ALNUM = table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


def words(data: np.ndarray, off: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes, and for each text the number of words before it.

    Words never cross texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = in_word[data]
    new = np.zeros(n + 1, bool)
    new[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | new[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | new[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts (A-Z lower-cased), and for each text the number of words before it."""
    data = LOWER[data]
    starts, ends, before = words(data, off, in_word)
    return Rolling(data)(starts, ends), before


_STEP = 0x9FB21C651E98DF25


def gram_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive values, by the first; also those that cross texts."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = values[:n].copy()
    for i in range(1, width):
        total += values[i : i + n] * _U(pow(_STEP, i, 1 << 64))
    return mix(total + _U(width))


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the size of each list."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
