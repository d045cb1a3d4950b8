"""Texts of an Arrow batch as arrays: words, hashes of words and of runs of words or bytes.

The functions here are the small helpers that the operators call inside Spark tasks. They work on
slices of a few megabytes, so a task needs the same memory whatever the size of its partition; only
a single text that is longer than a slice is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_SPREAD_1, _SPREAD_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of SplitMix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_SPREAD_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_SPREAD_2)
    x ^= x >> np.uint64(31)
    return x


# One random 64-bit value for each byte value, derived from the rule above.
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def _table(predicate) -> np.ndarray:
    return np.array([predicate(b) for b in range(256)], dtype=bool)


# Bytes of words after lower-casing: digits, letters, and every byte of a non-ASCII character.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
# Bytes of words set apart by white space.
NON_SPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Texts:
    """Texts laid one after another: ``data[bounds[i]:bounds[i + 1]]`` are the bytes of text i."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def texts_of(column: pa.Array) -> Texts:
    """Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.type in (pa.string(), pa.large_string()) \
        else column.fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0]:offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes together."""
    if batch.num_rows == 0:
        return
    bounds = texts_of(batch.column(column)).bounds
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        part = batch.slice(start, stop - start)
        yield part, texts_of(part.column(column))
        start = stop


@dataclass
class Words:
    """Words of several texts in order: their hash, the text they are in, and their bytes' bounds."""

    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray  # of each text, the index of its first word; one more entry at the end
    begin: np.ndarray
    end: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: Texts, member: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of ``member`` bytes, never across texts, hashed after lower-casing A-Z."""
    data, bounds = texts.data, texts.bounds
    n = len(data)
    inside = member[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = bounds[:-1]
    before[starts[starts < n]] = False
    ends = bounds[1:]
    after[ends[ends > 0] - 1] = False
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    hashes = ranges_hashes(LOWER[data] if lower else data, begin, end)
    first = np.searchsorted(begin, bounds)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(hashes, text, first, begin, end)


def ranges_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each range."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` neighbours, by its start; runs ignore where texts end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = np.uint64(_MULTIPLIER)
    for k in range(size):
        total *= factor
        total += hashes[k:k + n]
    return mixed(total + np.uint64(size))


def byte_run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` bytes, by its start."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=sums[1:])
    return mixed((sums[size:] - sums[:n]) * down[:n])


def whole_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` items that lie within one text, given where texts begin."""
    total = int(first[-1])
    if total < size:
        return np.zeros(0, np.int64)
    lengths = np.maximum(np.diff(first) - size + 1, 0)
    begins = np.repeat(first[:-1], lengths)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return begins + within


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Of each window of ``size`` values, by its start, where its least value is (last one of ties)."""
    if len(values) < size:
        return np.zeros(0, np.int64)
    least, place, width = values, np.arange(len(values)), 1

    def merged(shift: int):
        right = least[shift:] <= least[:-shift]
        return (np.where(right, least[shift:], least[:-shift]),
                np.where(right, place[shift:], place[:-shift]))

    while width * 2 <= size:
        least, place = merged(width)
        width *= 2
    if size > width:
        least, place = merged(size - width)
    return place


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def run_edges(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, with the length of ``values`` at the end."""
    if len(values) == 0:
        return np.zeros(1, np.int64)
    change = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], change, [len(values)]))
