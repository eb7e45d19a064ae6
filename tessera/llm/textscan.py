"""Vectorised word, line and n-gram hashing over Arrow string columns.

A batch is cut into slices of bounded bytes (a longer text is a slice of its own). Every text is read whole.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is `[^\\x20\\x09-\\x0D]+` on UTF-8.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks that keep the first 0 to 8 bytes of a little-endian block of 8.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def give_back() -> None:
    """Return freed memory of this worker to the system; Spark keeps workers between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def wide_view(padded: np.ndarray) -> np.ndarray:
    """The 8 bytes at every offset of bytes that end with 8 spare ones, as a number."""
    return np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))


def blocks_at(wide: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes at each offset, those beyond ``left`` bytes zero."""
    return wide[at] & FIRST_BYTES[np.minimum(left, 8)]


def same_bytes(wide_a: np.ndarray, a: np.ndarray, wide_b: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at each offset ``a`` are those at ``b``."""
    same = blocks_at(wide_a, a, size) == blocks_at(wide_b, b, size)
    long = np.flatnonzero(same & (size > 8))
    if len(long):
        more = (size[long] - 1) >> 3
        upto = np.cumsum(more) - more
        k = 8 * (np.arange(int(more.sum())) - np.repeat(upto, more) + 1)
        left = np.repeat(size[long], more) - k
        equal = blocks_at(wide_a, np.repeat(a[long], more) + k, left) == blocks_at(wide_b, np.repeat(b[long], more) + k, left)
        same[long] = np.logical_and.reduceat(equal, upto)
    return same


class Slice:
    """Words of a run of texts: ``bounds[i]:bounds[i + 1]`` are the words of text ``i``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold_case: bool, gap: np.ndarray = IS_SPACE):
        if fold_case:
            data = LOWER[data]
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        word = ~gap[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = offsets[:-1]
        inner = inner[inner < len(data)]
        first[inner] = word[inner]
        last = word.copy()
        last[:-1] &= ~word[1:]
        ends = offsets[1:] - 1
        ends = ends[ends >= 0]
        last[ends] = word[ends]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._wide = None

    @property
    def wide(self) -> np.ndarray:
        if self._wide is None:
            padded = np.zeros(len(self.data) + 8, np.uint8)
            padded[:-8] = self.data
            self._wide = wide_view(padded)
        return self._wide

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hash of the bytes of each span, equal for equal bytes wherever they stand.

        Each block of 8 bytes is mixed with its place in the span by itself, bits of all its bytes in all places of a product,
        before blocks are added: no sum of bytes with weights, which strings made of two alternating blocks can cancel.
        Other seeds give independent hashes.
        """
        size = ends - starts
        with np.errstate(over="ignore"):
            key = mix(np.array([seed], U) + U(0x9E3779B97F4A7C15))
            h = mix(blocks_at(self.wide, starts, size) ^ key)
            long = np.flatnonzero(size > 8)
            if len(long):
                more = (size[long] - 1) >> 3
                upto = np.cumsum(more) - more
                k = np.arange(int(more.sum())) - np.repeat(upto, more) + 1
                left = np.repeat(size[long], more) - 8 * k
                place = mix(k.astype(U) * U(0xD1B54A32D192ED03) + key)
                h[long] += np.add.reduceat(mix(mix(blocks_at(self.wide, np.repeat(starts[long], more) + 8 * k, left) ^ place) + place), upto)
            return mix(h + size.astype(U) * U(0xD6E8FEB86659FD93))

    def words(self, seed: int = 0) -> np.ndarray:
        return self.span_hash(self.starts, self.ends, seed)

    def word_text(self) -> np.ndarray:
        """The text's index of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.bounds))


def ngrams(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word index and hash of every window of ``n`` words that stays inside one text."""
    total = len(words)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    room = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(total) + n <= room)
    with np.errstate(over="ignore"):
        h = words[at]
        for k in range(1, n):
            h = mix(h * U(0xA0761D6478BD642F) + words[at + k])
    return at, h


def slices(column: pa.Array | pa.ChunkedArray, fold_case: bool = False, gap: np.ndarray = IS_SPACE) -> Iterator[tuple[int, int, Slice]]:
    """``(from, to, Slice)`` over the rows of a string column; null counts as empty. ``gap``: the bytes between words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, Slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold_case, gap)
        i = j
    give_back()
