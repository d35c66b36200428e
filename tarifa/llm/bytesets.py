"""Numpy helpers inside tasks: hashes of words, shingles and byte strings of Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def release() -> None:
    """Give freed memory back to the system: a worker lives on, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its memory
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Prefix polynomial hashes of a byte array: the hash of any [a, b) in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        inverse = np.full(n + 1, _INVERSE, dtype=np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse, out=inverse)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        # bytes pass through a table of random weights, so that low bits are mixed as well
        np.cumsum(_WEIGHTS[data] * powers[:n], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


_WEIGHTS = mix(np.arange(1, 257, dtype=np.uint64))


def chunks(texts: pa.Array, size: int = 700_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about `size` bytes; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), len(texts), i + 60_000)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        release()
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start) of every word of rows in one byte array; A-Z count as a-z."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.ones(n, dtype=bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first[:n]))
    after = np.ones(n, dtype=bool)
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    upper = (data >= 65) & (data <= 90)
    prefix = Prefix(np.where(upper, data + np.uint8(32), data))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return mix(prefix(starts, ends) + (ends - starts).astype(np.uint64)), rows, starts


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every run of `width` words; a row with fewer words has one shingle of all."""
    h, rows, _ = words(data, offsets)
    if not len(h):
        return h, rows, rows
    n = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    factor = np.uint64(0xD1342543DE82EF95)
    # Horner over the words that belong to the same row
    out = np.zeros(len(h), dtype=np.uint64)
    left = (first + n)[rows] - np.arange(len(h))
    for k in range(width):
        moved = np.zeros_like(h)
        moved[: max(0, len(h) - k)] = h[k:]
        out = np.where(left > k, out * factor + moved, out)
    whole = (left >= width) | ((n[rows] < width) & (np.arange(len(h)) == first[rows]))
    at = np.flatnonzero(whole)
    return mix(out[at] + np.minimum(n[rows[at]], width).astype(np.uint64)), rows[at], at - first[rows[at]]
