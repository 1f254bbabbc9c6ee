"""Word and shingle hashes of whole Arrow batches, on bytes with NumPy.

The word separators are ASCII, so UTF-8 texts can be cut at the byte level. A
word's hash adds a random 64-bit number for each (byte, place) pair, so it is
the same wherever the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_TAB = _RNG.integers(0, 1 << 64, 64 * 256, dtype=np.uint64)
_K = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes handled at once; only a single longer text goes beyond.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about CHUNK bytes together."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return
    col = col.cast(pa.large_string()).fill_null("")
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        end = min(end, len(col))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of the first one (one more at the end)."""
    low = _LOWER[data]
    word = ~_SPACE[low]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = word[inner]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    part = _TAB[((place & 63) << 8) | low]
    far = np.flatnonzero(word & (place > 63))
    if len(far):
        part[far] *= mix(place[far] >> 6) | np.uint64(1)
    part[~word] = 0
    return mix(np.add.reduceat(part, starts)), np.searchsorted(starts, offsets)


def shingle_sets(col: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; the whole sequence where it is shorter."""
    for first, data, offsets in text_chunks(col):
        hashes, at = word_hashes(data, offsets)
        n = len(hashes) - size + 1
        every = np.zeros(0, np.uint64)
        if n > 0:
            every = hashes[:n] * _K[0]
            for j in range(1, size):
                every += hashes[j : j + n] * _K[j]
            every = mix(every)
        for i in range(len(offsets) - 1):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= size:
                yield first + i, np.unique(every[a : b - size + 1])
            elif b > a:
                short = hashes[a:b] * _K[32 : 32 + b - a]
                yield first + i, mix(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield first + i, np.zeros(0, np.uint64)
