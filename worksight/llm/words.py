"""Words of many texts at once, on flat byte arrays.

An Arrow column of texts is one run of UTF-8 bytes plus offsets.  Words,
their hashes and the hashes of word windows are found for a whole slice of
rows with a few array operations, without a Python object per word.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Letters and everything beyond ASCII.
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_STEP = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U) * U(_STEP))
_PLACE = mix(np.arange(1, 65, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)
_BASE = 0xC2B2AE3D27D4EB4F
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash base and of its inverse, up to ``n``."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(max(n, 1 << 20), base, dtype=U)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of the rows of one slice.  ``first[i]:first[i + 1]`` are row i's words."""
    low: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def sums(self) -> np.ndarray:
        sums = np.zeros(len(self.low) + 1, dtype=U)
        values = _BYTE[self.low]
        values *= _power(len(self.low) + 1)[0][:len(self.low)]
        np.cumsum(values, out=sums[1:])
        return sums

    def hashes(self, sums: np.ndarray | None = None, stop: np.ndarray | None = None,
               start: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word, or of the given byte spans."""
        sums = self.sums() if sums is None else sums
        start = self.start if start is None else start
        stop = self.stop if stop is None else stop
        h = (sums[stop] - sums[start]) * _power(len(self.low) + 1)[1][start]
        return mix(h + (stop - start).astype(U) * U(_STEP))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(column, size: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``size`` bytes: first row, end row, bytes, bounds.
    A longer text is a slice of its own; no text is cut."""
    data, at = flat(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + size, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def split(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    """Words as runs of bytes that ``table`` marks, after lowering A-Z.  No word crosses a row."""
    low = _LOWER[data]
    inside = table[low]
    begin, end = inside.copy(), inside.copy()
    if len(low):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        at = bounds[:-1][bounds[:-1] < len(low)]
        begin[at] = inside[at]
        at = bounds[1:][bounds[1:] > 0] - 1
        end[at] = inside[at]
    start = np.flatnonzero(begin)
    return Words(low, bounds, start, np.flatnonzero(end) + 1, np.searchsorted(start, bounds))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, rows disregarded."""
    n = max(len(h) - k + 1, 0)
    g = np.full(n, (k * _STEP) % (1 << 64), dtype=U)
    for j in range(k):
        g += h[j:n + j] * _PLACE[j]
    return mix(g)


def window_starts(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """The words from which a window of k words fits into its row."""
    fits = np.ones(total, dtype=bool)
    for j in range(1, k):
        last = first[1:] - j
        fits[last[(last >= first[:-1]) & (last >= 0)]] = False
    return np.flatnonzero(fits)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 52-bit hash of each distinct window of k words, sorted by both.
    A row with fewer words, but not none, has its whole sequence as one window."""
    h, rows = words.hashes(), words.rows()
    starts = window_starts(words.first, k, len(h))
    keys = [(rows[starts].astype(U) << U(52)) | (window_hashes(h, k)[starts] >> U(12))]
    for n in range(1, k):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            g = np.full(len(short), (n * _STEP) % (1 << 64), dtype=U)
            for j in range(n):
                g += h[words.first[short] + j] * _PLACE[j]
            keys.append((short.astype(U) << U(52)) | (mix(g) >> U(12)))
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> U(52)).astype(np.int64), key & U((1 << 52) - 1)
