"""Vectorised helpers on Arrow batches of texts, for use inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task handles at once; a longer single text is handled whole.
CHUNK_BYTES = 1_000_000


#: Gives the allocator's free memory back, where the C library can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def row_chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes in `column` and `rows` rows at most, so that memory doesn't follow the batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + limit, "right"))))
            yield batch.slice(at, to - at)
            at = to
    # the worker lives on; its next task may do something else
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows (one more than rows); nulls are empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """`n` odd 64-bit numbers that depend on `seed` alone."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


@lru_cache(4)
def byte_classes(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes make words, and a number for each byte, upper-case A-Z as lower-case.

    blank: words are what white space (0x20, 0x09 to 0x0D) separates; letters: words are ASCII
    letters and digits and all bytes beyond ASCII, anything else separates.
    """
    low = np.arange(256)
    low[65:91] += 32
    word = np.ones(256, bool)
    if kind == "blank":
        word[[32, *range(9, 14)]] = False
    else:
        word[:128] = [chr(i).isalnum() for i in range(128)]
    return word, constants(256, 11)[low]


def words(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: 64-bit hash, row, first byte, byte after the last. A row's edge ends a word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    is_word, numbers = byte_classes(kind)
    inside = is_word[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    opens[first] = inside[first]
    shuts = inside.copy()
    shuts[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    shuts[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers[data] * up, out=total[1:])
        hashes = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def grams(hashes: np.ndarray, rows: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `n` words of one row, and the number of its first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.full(m, seed + n, np.uint64)
        for c, k in zip(constants(n, seed), range(n), strict=True):
            out += hashes[k : k + m] * c
        at = np.flatnonzero(rows[:m] == rows[n - 1 :])
        return mixed(out[at]), at
