"""Words and word windows of a batch of texts as numpy arrays.

A batch's texts lie end to end in one buffer. Hashes are polynomials modulo
2 ** 64 taken from prefix sums, so a batch costs a few passes over its bytes,
however long the words and the windows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: A random-looking number for each byte, and two odd bases, each with its inverse modulo 2 ** 64.
BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


class Powers:
    """Powers of a base and of its inverse, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + (1 << 18)
            self.up, self.down = (np.cumprod(np.r_[U64(1), np.full(size - 1, b, U64)]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = [Powers(b) for b in BASES]


def window_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of values[start:stop] for each window; depends on the values and their order only."""
    up, down = _POWERS[lane].to(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U64))


@dataclass
class Words:
    """Of a batch: hash, first and end byte of each word; first[d] : first[d + 1] are the words of text d."""

    buffer: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: pa.Array, lower: bool = False, between: np.ndarray = SPACE) -> Words:
    """Words are what stands between ASCII white space, or between the bytes that ``between`` marks; lower: A-Z count as
    a-z. Null texts have none."""
    column = texts.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buffer = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        buffer = LOWER[buffer]
    space = between[buffer]
    edge = np.zeros(len(buffer) + 1, bool)
    edge[offsets] = True
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = window_hashes(BYTES[buffer], start, end) if len(start) else np.zeros(0, U64)
    return Words(buffer, hashes, start, end, np.searchsorted(start, offsets))


def parts(batch: pa.RecordBatch, text: str, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of text, a row at least. Memory that Arrow keeps for reuse is freed then."""
    column = batch.column(text).cast(pa.large_binary())
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group of those sizes."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
