"""Word and shingle hashing over Arrow text columns, whole batches at a time.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; ASCII and Latin-1 letters are folded to
lower case. Words are hashed with a polynomial prefix hash modulo 2**64, so all words of a slice
of documents come out of a handful of numpy passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.default_rng(20240607)
_BASE = U64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_WORD[0x80:] = True
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with capital Latin-1 letters (C3 80 to C3 9E, but not the multiplication sign) as small ones; ASCII is folded by ``_CODE``."""
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] <= 0x9E) & (data[at] != 0x97)]
    if len(at):
        data = data.copy()
        data[at] += 0x20
    return data


class Slice:
    """Some consecutive rows of a batch: their bytes, and where each row starts and ends."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into slices of about ``limit`` bytes; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_utf8())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Slice(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


class Words:
    """The words of a slice: hash, byte range and, for each row, the range of its words."""

    def __init__(self, part: Slice):
        data, n = part.data, len(part.data)
        is_word = np.zeros(n + 1, bool)
        is_word[:n] = _WORD[data]
        before = np.zeros(n + 1, bool)
        before[1:] = is_word[:-1]
        before[part.offsets] = False  # a row starts afresh
        self.start = np.flatnonzero(is_word & ~before)
        ends = is_word[:-1] & ~is_word[1:]
        inner = part.offsets[(part.offsets > 0) & (part.offsets <= n)] - 1
        ends[inner] = is_word[inner]
        self.end = np.flatnonzero(ends) + 1
        up, down = _powers_of(n + 1)
        data = folded(data)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_CODE[data] * up[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.bounds = np.searchsorted(self.start, part.offsets)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, by its first word; the last k-1 places are missing."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n] * _STEP[0]
        for j in range(1, k):
            out = out + words[j : j + n] * _STEP[j]
        return mix(out)


def row_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows, one after another, and each row's bounds.

    A row of fewer than k words has one shingle of all its words; a row without words has none.
    """
    counts = np.diff(words.bounds)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    every = shingles(words.hash, k)
    out = np.zeros(bounds[-1], np.uint64)
    if len(every):
        row = np.repeat(np.arange(len(counts)), np.where(counts >= k, sizes, 0))
        local = np.arange(len(row)) - np.repeat((np.cumsum(np.where(counts >= k, sizes, 0)) - np.where(counts >= k, sizes, 0)), np.where(counts >= k, sizes, 0))
        out[bounds[row] + local] = every[words.bounds[row] + local]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        own = words.hash[words.bounds[r] : words.bounds[r + 1]]
        with np.errstate(over="ignore"):
            out[bounds[r]] = mix((own * _STEP[: len(own)]).sum(dtype=np.uint64) + U64(len(own)))[()]
    return out, bounds


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Cut a contiguous array into binary values at ``bounds`` (in elements)."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64) * size), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
