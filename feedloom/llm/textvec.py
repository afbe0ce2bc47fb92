"""Words and word hashes of whole Arrow columns, computed on the UTF-8 bytes with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; both can be changed. Every byte above 0x7F belongs to a word, so the
work can be done on bytes. A word's hash is a polynomial over a random 64-bit value per byte; all word hashes
of a chunk come from one running sum. Two different words share a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All ASCII characters but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_VALUE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=U)
_EXACT = _VALUE.copy()
_VALUE[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_STEP = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_powers = [np.ones(0, U), np.ones(0, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, U(base))
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of rows ``first`` up to ``last``; offsets are into ``data``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray  # bytes of row first+i: offsets[i] to offsets[i+1]
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words of row first+i: bounds[i] to bounds[i+1]

    def of(self, i: int) -> slice:
        return slice(self.bounds[i - self.first], self.bounds[i - self.first + 1])


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def words(column: pa.Array, chunk_bytes: int = CHUNK_BYTES, separators: np.ndarray = SPACE, fold_case: bool = True) -> Iterator[Words]:
    """Whole rows together until about ``chunk_bytes``; a longer text is a chunk of its own."""
    offsets, data = _buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        last = min(last, rows)
        yield _words(first, last, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]], separators, _VALUE if fold_case else _EXACT)
        first = last


def _words(first: int, last: int, offsets: np.ndarray, data: np.ndarray, separators: np.ndarray, value: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(first, last, data, offsets, none, none, np.zeros(0, U), np.zeros(last - first + 1, np.int64))
    space = separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:n]
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(value[data] * power[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))
    return Words(first, last, data, offsets, start, end, hashed, np.searchsorted(start, offsets))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words, and where each row's begin (rows with under k words have none)."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, U), np.zeros(len(w.bounds), np.int64)
    g = np.zeros(n - k + 1, U)
    for j in range(k):
        g = mix(g + w.hash[j : n - k + 1 + j] * _STEP[j % 5])
    row = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    inside = row[: n - k + 1] == row[k - 1 :]
    kept = np.flatnonzero(inside)
    return g[kept], np.searchsorted(kept, w.bounds)


def few(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole sequence of fewer words than a shingle has."""
    h = np.full(1, len(hashes), U)
    for j in range(len(hashes)):
        h = mix(h * _STEP[4] + hashes[j : j + 1])
    return h[0]


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): k-word shingles; the whole sequence if there are fewer words."""
    for w in words(column):
        g, at = grams(w, k)
        for i in range(w.last - w.first):
            if at[i] < at[i + 1]:
                yield w.first + i, np.unique(g[at[i] : at[i + 1]])
            elif w.bounds[i] < w.bounds[i + 1]:
                yield w.first + i, few(w.hash[w.bounds[i] : w.bounds[i + 1]]).reshape(1)
            else:
                yield w.first + i, np.zeros(0, U)


def sequences(w: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for each run of words begin[i] up to end[i]."""
    power, inverse = powers(len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, U)
    np.cumsum(w.hash * power[: len(w.hash)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U) * _STEP[0])


def signed(x: np.ndarray) -> np.ndarray:
    """Spark has no unsigned longs."""
    return x.view(np.int64)
