"""Words and word shingles of many texts at once, as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Texts are taken as UTF-8 bytes in blocks of about a megabyte; a word never crosses a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_U = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, m in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, m, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; null texts are empty."""
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if (sizes != np.diff(offsets)).any():  # a null may cover bytes
            yield from blocks(column.fill_null(b"" if pa.types.is_large_binary(column.type) else ""), limit)
            return
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray = _BYTE) -> np.ndarray:
    """Polynomial hash of each span, from prefix sums, mixed with its length. ``bits``: 64 of them for each value in ``data``."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(bits[data] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows of ``size``, row by row, and their bounds.

    ``bounds`` holds the first word of each row and, last, the number of words. A row with fewer words, but at least
    one, has one shingle: its whole sequence.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(out_bounds[-1], np.uint64)
    if not len(out):
        return out, out_bounds
    rows = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(out)) - out_bounds[rows] + bounds[rows]
    width = np.minimum(counts[rows], size)
    acc = width.astype(np.uint64)
    last = len(words) - 1
    for k in range(size):
        nxt = mixed(acc * _U(0xD6E8FEB86659FD93) + words[np.minimum(at + k, last)])
        acc = np.where(width > k, nxt, acc) if (counts < size).any() else nxt
    return acc, out_bounds


def text_shingles(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word counts, shingle hashes, shingle bounds) for each block of rows, A-Z lower-cased."""
    for first, _, data, offsets in blocks(column):
        data = LOWER[data]
        starts, ends, rows = word_spans(data, offsets)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        hashes, at = shingles(word_hashes(data, starts, ends), bounds, size)
        yield first, np.diff(bounds), hashes, at
