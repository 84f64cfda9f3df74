"""Vectorised byte, word and n-gram hashing over Arrow text batches.

Tasks of several operators hash every word of every text.  Here that is done
on the UTF-8 buffer of a whole Arrow slice with numpy: no per-word Python.
A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; all of those
are ASCII, so cutting bytes never cuts a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20          # text bytes hashed at a time in a task

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_N_STEP = np.arange(256, dtype=np.uint64) * _STEP
_EXACT = np.arange(1, 257, dtype=np.uint64)
_LOWER = _EXACT.copy()
_LOWER[ord("A"):ord("Z") + 1] += np.uint64(32)


def _geometric(base, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
               lengths: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each run ``values[s:s+n]`` (uint64, n >= 1); the runs lie back to back from 0.

    Each value is mixed with its place before the sum: a plain polynomial modulo
    2^64 gives a Thue-Morse word and its complement one hash, whatever its base.
    ``lengths`` replaces the runs' sizes where values of 0 at their ends don't count.
    """
    inside = np.arange(len(values), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), sizes)
    each = mix(values + (inside + np.uint64(1)) * _STEP)
    if lengths is None:
        lengths = sizes
    else:
        each[values == 0] = 0
    return mix(np.add.reduceat(each, starts) + lengths.astype(np.uint64) * _BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (finaliser of the 64-bit Murmur hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_slices(batch: pa.RecordBatch, column: str = "text",
                slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of at most ``slice_bytes`` of text (one row at least).

    Yields (rows, bytes, offsets): the rows, their text as one uint8 array, and
    len(rows)+1 offsets into it.  A null text is empty.
    """
    for lo, hi in _row_runs(batch, column, slice_bytes):
        part = batch.slice(lo, hi - lo)
        data, offsets = text_buffer(part.column(part.schema.get_field_index(column)))
        yield part, data, offsets


def text_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes (uint8) and offsets (int64, from 0) of a string or binary array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, off, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64, count=len(arr) + 1 + arr.offset)[arr.offset:]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _row_runs(batch, column, slice_bytes):
    arr = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if not n:
        return
    ends = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=n + 1 + arr.offset)[arr.offset:]
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(ends, ends[lo] + slice_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of a slice: 64-bit hash, first byte, byte after the last, row."""
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray       # first word of each row, len(rows) + 1 entries


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, apart: np.ndarray = SPACE) -> Words:
    """Hash every word of every row; ``lower`` folds A-Z first, ``apart`` marks the bytes between words."""
    n, rows = len(data), len(offsets) - 1
    solid = ~apart[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets[:-1]] = True
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1] | begins[1:n]
    start = np.flatnonzero(fresh)
    if not len(start):
        e = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), e, e, e, np.zeros(rows + 1, np.int64))
    last = solid.copy()
    last[:-1] &= ~solid[1:] | begins[1:n]
    end = np.flatnonzero(last) + 1
    size = end - start
    h = run_hashes((_LOWER if lower else _EXACT)[data[solid]], np.cumsum(size) - size, size)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(h, start, end, row, first)


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a row, and the index of each first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[n - 1:])
    acc = h[at]
    for k in range(1, n):
        acc = acc * _BASE + h[at + k]
    return mix(acc + _N_STEP[n]), at


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices ``start[i] .. start[i] + size[i] - 1`` of all i, one after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum()), dtype=np.int64) + np.repeat(start - before, size)


def same_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray,
               other: np.ndarray, other_start: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether ``data[start:start+size]`` equals ``other[other_start:other_start+other_size]``, run by run (no run empty)."""
    same = size == other_size
    if same.any():
        n = size[same]
        equal = data[ragged(start[same], n)] == other[ragged(other_start[same], n)]
        same[same] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return same


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long."""
    return x.view(np.int64)
