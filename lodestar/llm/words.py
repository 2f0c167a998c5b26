"""Vectorised words and hashes over the raw UTF-8 buffers of Arrow text columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are 64-bit:
a window of units ``u_i`` hashes to ``sum(u_i * P**(i - start))`` modulo ``2**64``,
taken from one prefix sum, then mixed. Two of n different windows collide with a
probability near ``n**2 / 2**65``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK_BYTES = 1 << 20
#: Batches of so many bytes leave enough free memory behind to give it back.
LARGE_BYTES = 8 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n at least; kept for the process."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, p, np.uint64)))) for p in (_P, _P_INV)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[ord("A") : ord("Z") + 1] += 32
    return mix(codes + np.uint64(1))


_TABLES = {flag: _table(flag) for flag in (False, True)}


def prefix(units: np.ndarray) -> np.ndarray:
    """Sums that hash any window of units; see between()."""
    with np.errstate(over="ignore"):
        return np.concatenate(([np.uint64(0)], np.cumsum(units * powers(len(units) + 1)[0][: len(units)], dtype=np.uint64)))


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of units[start:end] for each pair, independent of where it stands, from their prefix()."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64) * _P)


def windows(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return between(prefix(units), starts, ends)


class Words:
    """Words of a run of texts: starts, ends (bytes), hashes, and per text the slice first[i]:first[i + 1].

    sums: the prefix() of the bytes' units, where the caller has it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, sums: np.ndarray | None = None):
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = ~space[1:]
        self.starts = np.flatnonzero(inside[: len(data)] & (space[: len(data)] | edge[: len(data)]))
        self.ends = np.flatnonzero(~space[1:-1] & (space[2:] | edge[1:])) + 1
        self.hashes = between(prefix(_TABLES[lower][data]) if sums is None else sums, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows and the index of each one's first word."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))
        at = np.flatnonzero(left >= k)
        return windows(self.hashes, at, at + k), at


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def release() -> None:
    """Give this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; the worker gives free memory back after each large batch and at the end, instead of holding it."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            if batch.nbytes >= LARGE_BYTES:
                del batch
                release()

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(taken(batches))
        release()

    return tidied


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, concatenated."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
