"""Words of Arrow batches of texts, worked on as flat NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def plain(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array, nulls as empty texts.

    Its values are copied: Arrow's ascii_lower misreads a slice whose offsets do not start at 0.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "").take(pa.array(np.arange(len(col))))


def lots(batches: Iterator[pa.RecordBatch], at: int = 0, rows: int = 2000, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, and ``size`` bytes in column ``at`` unless one text alone has more."""
    for b in batches:
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(at)), 0)).astype(np.int64))])
        low = 0
        while low < b.num_rows:
            high = int(np.searchsorted(ends, ends[low] + size, side="right")) - 1
            high = min(max(high, low + 1), low + rows, b.num_rows)
            yield b.slice(low, high - low)
            low = high
            pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """The words of a batch: ``code`` indexes ``unique``, ``start[i]:start[i + 1]`` are text i's."""

    code: np.ndarray
    unique: pa.Array
    start: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.unique.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.unique))
        return own[self.code] if len(own) else np.zeros(0, np.uint64)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def words(col: pa.Array | pa.ChunkedArray, lower: bool) -> Words:
    """Runs of anything but ASCII white space; ``lower``: A to Z in lower case first."""
    texts = plain(col)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    full = np.asarray(pc.not_equal(flat, "")).astype(bool)  # white space at an end leaves an empty string there
    start = np.concatenate([[0], np.cumsum(full)])[bounds]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return Words(np.asarray(coded.indices).astype(np.int64), coded.dictionary, start)


def windows(h: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words and the place of each one's first word; none spans two texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x = mixed(x * _A + h[i : n + i])
    left = np.repeat(start[1:], np.diff(start))[:n] - np.arange(n)  # words to the end of the text
    at = np.flatnonzero(left >= k)
    return x[at], at
