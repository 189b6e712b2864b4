"""Small numpy helpers over Arrow text columns, shared by the kernels of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U64 = np.uint64
#: An odd multiplier and, below, its inverse modulo 2**64: a word's hash is a slice of one running sum.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63 - 1, 256, dtype=np.uint64) | _U64(1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and each row's start and end in them; a null is an empty row."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        ends[column.is_null().to_numpy(zero_copy_only=False)] = starts[column.is_null().to_numpy(zero_copy_only=False)]
    low = int(at[0])
    return data[low : int(at[-1])], starts - low, ends - low


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes of text, at least one row each: bounds what numpy holds at once."""
    _, starts, ends = text_buffers(batch.column(column))
    sums = np.concatenate([[0], np.cumsum(ends - starts)])
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(sums, sums[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, until - at)
        at = until


def freeing(kernel: Callable) -> Callable:
    """``kernel`` over batches, which gives unused memory back when it is done: Python workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return run


def counted(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of all arrays, ascending, and how often each is there. Empties the list."""
    every = np.concatenate(values)
    values.clear()
    every.sort()
    head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[head], np.diff(np.append(head, len(every)))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U64(27))
    h = h * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def running_sum(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sums`` and ``scale``: ``(sums[e] - sums[s]) * scale[s]`` depends on ``values[s:e]`` alone."""
    n = len(values)
    powers = np.empty(n, _U64)
    scale = np.empty(n + 1, _U64)
    if n:
        powers[0] = scale[0] = 1
        powers[1:] = _U64(_BASE)
        np.cumprod(powers, out=powers)
    scale[0] = 1
    scale[1:] = _U64(_INVERSE)
    np.cumprod(scale, out=scale)
    sums = np.zeros(n + 1, _U64)
    np.cumsum(values * powers, out=sums[1:])
    return sums, scale


def word_spans(data: np.ndarray, starts: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are no separators; runs end where a row begins."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def white_space() -> np.ndarray:
    """Which bytes separate words: space and 0x09 to 0x0D."""
    table = np.zeros(256, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


def lower_table() -> np.ndarray:
    """Byte to byte, with A-Z lowered."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def hash_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(begin) == 0:
        return np.zeros(0, _U64)
    sums, scale = running_sum(_BYTE_VALUES[data])
    h = (sums[end] - sums[begin]) * scale[begin]
    return mix(h ^ (end - begin).astype(_U64) * _U64(0xD6E8FEB86659FD93))


def hash_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` neighbours, by the place of its first."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U64)
    out = np.zeros(n, _U64)
    for j in range(width):
        out *= _U64(_BASE)
        out += hashes[j : j + n]
    return mix(out)


def row_of(begin: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each ascending position, the row that holds it."""
    return np.searchsorted(ends, begin, side="right") if len(begin) else np.zeros(0, np.int64)
