"""Hashes of the words of Arrow text columns, for many documents at a time, in numpy.

A word is a run of bytes other than the six ASCII white-space characters, so a UTF-8 word is
hashed whole. Word hashes have 64 bits: a polynomial of random byte values with random odd
multiplier, then a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[_SPACE] = 0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))
#: Bytes of text that are hashed at once; a longer document is hashed by itself.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = MULTIPLIER) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and the first word of each document (and the end).

    Document i is data[bounds[i] : bounds[i + 1]].
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none, np.zeros(len(bounds), dtype=np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds - bounds[0]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(start)
    end = inside
    end[:-1] &= ~inside[1:] | edge[1:-1]
    ends = np.flatnonzero(end) + 1
    if not len(starts):
        return none.astype(np.uint64), none, none, np.zeros(len(bounds), dtype=np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    longest = int((ends - starts).max())
    np.clip(place, 0, longest - 1, out=place)
    value = _BYTE[data]
    value *= powers(longest)[place]
    hashes = mix(np.add.reduceat(value, starts))
    return hashes, starts, ends, np.searchsorted(starts, bounds - bounds[0])


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, bounds) for runs of documents of about SLICE_BYTES."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n consecutive values; shorter input has none."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    power = powers(len(hashes))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * power, dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * powers(len(hashes) - n + 1, INVERSE))
