"""Words of many texts at once, as numpy arrays over Arrow's own buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. Words and runs of words are compared by 64-bit
hashes: with 10**8 different ones, the chance that any two are confused is about 3 in 10**4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_STEP = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values; other seeds give independent values."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def pieces(texts: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(size):
        yield start, len(size)


class Words:
    """Words of some texts: ``hashes``, the row ``doc`` of each, its bytes ``start:end``, and ``first`` word per row."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        column = pc.fill_null(texts, "").cast(pa.large_binary())
        n = len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        if lower:
            self.bytes = _LOWER[self.bytes]
        at = at - at[0]
        inside = ~_SPACE[self.bytes]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = at[:-1][np.diff(at) > 0]  # a text begins here
        begins[edges] = inside[edges]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.hashes = self._hashed(inside)

    def _hashed(self, inside: np.ndarray) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        powers = np.cumprod(np.full(int(size.max()), _STEP, np.uint64))
        cut = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(cut, size)
        value = _BYTE[self.bytes[inside]] * powers[place]
        return mixed(np.add.reduceat(value, cut) + size.astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i]:self.end[i]].tobytes()

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k`` consecutive words of one text, and the index of each one's first word."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * _STEP + self.hashes[i:i + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return mixed(h[at], k), at


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of consecutive numbers in a sorted array: their first and last ones."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
