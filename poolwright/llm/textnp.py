"""Words and hashed word windows of many texts at once, in numpy.

Texts come as Arrow string columns and are handled in chunks of about
``CHUNK`` bytes, so memory is bounded by a chunk or one very long text.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C1B  # odd, 3 modulo 8
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_HASH = np.random.RandomState(20240501).randint(0, 1 << 64, 256, dtype=U64)
GRAM_HASH = np.random.RandomState(20240502).randint(0, 1 << 64, 64, dtype=U64) | U64(1)

# The bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
#: Lower case with every ASCII byte that is no letter or digit as a space.
PLAIN = LOWER.copy()
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words(NamedTuple):
    """Words of a chunk: hash, byte span within ``data``, and for each text
    the range ``bounds[i]:bounds[i + 1]`` of its words."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, data, offsets) of runs of texts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows``, for work that holds several
    times what it reads."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """Words of the texts that ``offsets`` cut from ``data``, after ``fold``."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64))
    folded = fold[data]
    inside = ~SPACE[folded]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    power = np.full(n, BASE, U64)
    power[0] = 1
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(BYTE_HASH[folded] * np.cumprod(power), out=total[1:])
    power[1:] = BASE_INVERSE
    hashed = (total[end] - total[start]) * np.cumprod(power)[start]
    return Words(mix(hashed + (end - start).astype(U64)), start, end, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words, across texts too; the window
    that begins at word i is window i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n] * GRAM_HASH[0]
    for j in range(1, size):
        out += hashes[j : j + n] * GRAM_HASH[j]
    return mix(out ^ U64(size))


def gram_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct windows of each text; of a text with fewer words
    all of them as one window; of a text without words none."""
    all_ = grams(w.hash, size)
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(all_[a : b - size + 1])
        else:
            yield grams(w.hash[a:b], b - a) if b > a else all_[:0]
