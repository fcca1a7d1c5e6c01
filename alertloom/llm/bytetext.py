"""Vector helpers over the UTF-8 bytes of many texts at once.

A batch of texts is one byte array plus row bounds, taken from the Arrow buffers
without copying. Words are found and hashed with array operations, so no Python
code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# A slice of a batch is worked on at a time, so that temporary arrays stay small
# whatever the length of the texts.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = 0x9E3779B97F4A7C15  # 5 mod 8, so that its powers differ in their low bits
_WORDS = 0xFF


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and row bounds (rows + 1). A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(bounds):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together; a longer row comes alone."""
    start, rows = 0, len(bounds) - 1
    while start < rows:
        stop = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and words before each row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, bounds)


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_ODD, -1, 1 << 64)
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_ODD, inverse):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        if n <= SLICE_BYTES + 1:
            _powers[:] = made
        return made[0], made[1]
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span; the place of a span does not matter."""
    n = len(data)
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_codes()[data] * power[:n], out=sums[1:])
    total = (sums[end] - sums[begin]) * inverse[begin]
    return mix64(total ^ ((end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i] .. start[i] + length[i]."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, length)


def sub_batches(batches: Iterator[pa.RecordBatch], text: int, limit: int = 8 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows:
            _, bounds = text_bytes(batch.column(text))
            for start, stop in row_slices(bounds, limit):
                yield batch.slice(start, stop - start)
