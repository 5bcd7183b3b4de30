"""Hashed word shingles of whole texts, computed on the bytes of many texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9DDFEA08EB382D69)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes and byte lengths of the words (runs of anything but ASCII white space, A-Z lower-cased) of a string column, and where each row's start (one more entry than rows)."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    size = 1 << max(16, int(len(data) - 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters()[lower] * up[: len(data)], out=sums[1:])
    length = ends - starts
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, length, np.searchsorted(starts, bounds)


def shingled(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of n words and the bytes of their words, with repetitions, and where each row's start. A row with fewer words (but one at least) has the whole sequence as its only shingle."""
    hashes, length, first = words(column)
    count = np.diff(first)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    where = np.concatenate(([0], np.cumsum(own)))
    at = np.repeat(first[:-1] - where[:-1], own) + np.arange(where[-1])
    short = np.repeat(count < n, own)
    last = np.repeat(first[1:], own)
    total, size = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for k in range(n):
        there = (at + k < last).astype(bool)
        place = np.minimum(at + k, max(0, len(hashes) - 1))
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + np.where(there, hashes[place], np.uint64(0)) + np.uint64(k + 1)) if len(hashes) else total
        size += np.where(there, length[place], 0) if len(hashes) else 0
    total ^= np.where(short, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
    return total, size, where
