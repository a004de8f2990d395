"""Vectorised scanning of a batch of texts: UTF-8 bytes, words, polynomial hashes and window anchors.

Everything works on one concatenated byte array per slice of documents, so that the cost per byte is a handful of
numpy operations, and a slice is a few MB however long the batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
_rng = np.random.default_rng(20240917)
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, min(SLICE, 2 * n))
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of TABLE[data[x]] * base**x for i <= x < j."""
    p, _ = powers(len(data))
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * p, out=c[1:])
    return c


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive 64-bit values; the result has max(0, n - k + 1) entries."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + values[i : i + n]
    return mix(h)


class Words:
    """Words (runs of anything but ASCII white space) of the documents in a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        n = len(data)
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(solid & (before | edge[:n]))
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each document, and the total

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        c = prefix_hash(self.data)
        _, inv = powers(len(self.data))
        return mix((c[self.end] - c[self.start]) * inv[self.start])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    d = 1
    while 2 * d <= w:
        v = np.minimum(v[:-d], v[d:])
        d *= 2
    return np.minimum(v[: len(v) - (w - d)], v[w - d :]) if w > d else v


def anchors(grams: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share out all windows of ``window`` units among content-chosen anchors.

    ``grams`` holds the hash of the k units from each position on, ``first`` the documents' first positions and
    the total. A window's anchor is the leftmost k-gram in it with the least hash (upper half), so equal windows
    have equal anchors at equal distances. Returns for each anchor its position, its first window's start and how
    many windows it has; these are consecutive.
    """
    w = window - k + 1
    none = np.zeros(0, np.int64)
    if len(grams) < w:
        return none, none, none
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(packed, w)
    length = np.diff(first)
    has = length >= window
    mark = np.zeros(len(least) + 1, np.int8)
    np.add.at(mark, first[:-1][has], 1)
    np.add.at(mark, first[1:][has] - window + 1, -1)
    s = np.flatnonzero(np.cumsum(mark[:-1]))
    if not len(s):
        return none, none, none
    at = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    i = np.flatnonzero(new)
    return at[i], s[i], np.diff(np.append(i, len(at)))


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs; spans that touch are one run."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    i = np.flatnonzero(new)
    return start[i], end[np.append(i[1:], len(start)) - 1]
