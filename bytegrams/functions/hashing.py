"""Hashes of byte and symbol windows, for a whole buffer at once. All arithmetic is modulo 2 ** 32.

Spark has no unsigned integers: outside numpy a hash is a LONG of 0 to 2 ** 32 - 1.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U32 = np.uint32
BASE = 31
INVERSE = pow(BASE, -1, 1 << 32)
#: The seeds of the two Murmur3 uses.
WINDOW_SEED, PHRASE_SEED = 1073741827, 0
#: Murmur3 (x86, 32 bits).
C1, C2, ADD, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
#: Fixed value: how many buckets there are unless said otherwise.
FILTER_SIZE = 2147483629


def finish(h: np.ndarray) -> np.ndarray:
    h = h.astype(U32)
    h = (h ^ (h >> U32(16))) * U32(MIX1)
    h = (h ^ (h >> U32(13))) * U32(MIX2)
    return h ^ (h >> U32(16))


@lru_cache(maxsize=4)
def symbol_table(width: int = 1) -> np.ndarray:
    """A number for each symbol: Murmur3's finisher of (symbol + 1) times an odd constant. For 4-byte symbols there is none."""
    return finish(np.arange(1, (1 << 8 * width) + 1, dtype=U32) * U32(0x9E3779B1))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.r_[U32(1), np.full(size - 1, b, U32)], dtype=U32) for b in (BASE, INVERSE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    return _powers(1 << max(10, (n - 1).bit_length()))


def rolling_hash(values: np.ndarray, n: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Sum of values[i + j] * 31 ** (n - 1 - j) for every window start i. values: numbers of the table, uint32.

    With S[t] the sum of values[j] * 31 ** -j below t, it is (S[i + n] - S[i]) * 31 ** (i + n - 1): no work grows with n.
    """
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U32)
    np.cumsum(values * down[: len(values)], out=sums[1:], dtype=U32)
    if starts is None:
        return (sums[n:] - sums[:-n]) * up[n - 1 : len(values)]
    return (sums[starts + n] - sums[starts]) * up[starts + n - 1]


def gram_hash(gram: bytes) -> int:
    """The rolling hash of one whole gram, term by term."""
    h, table = 0, symbol_table()
    for b in gram:
        h = (h * BASE + int(table[b])) & 0xFFFFFFFF
    return h


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` neighbours: of the rest of a block and the beginning of the next, whatever the size."""
    if len(x) < size:
        return x[:0]
    blocks = np.concatenate([x, np.full(-len(x) % size, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, size)
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    beginning = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(rest[: len(x) - size + 1], beginning[size - 1 : len(x)])


def anchors(values: np.ndarray, n: int) -> np.ndarray:
    """Where the anchor of every window of n symbols begins: of its pieces of n // 2 symbols the one whose hash is smallest, the
    first of equals. It depends on the window alone, so equal windows have equal anchors, at the same distance. As a window
    moves on the anchor never moves back, and stays for a quarter of n on average."""
    hashed = finish(rolling_hash(values, n // 2)).astype(U64)
    return (_sliding_min(hashed << U64(32) | np.arange(len(hashed), dtype=U64), n - n // 2 + 1) & U64(0xFFFFFFFF)).astype(np.int64)


def anchor_names(values: np.ndarray, n: int, places: np.ndarray) -> np.ndarray:
    """A number of 64 bits for the anchor at each place, for a bit map too."""
    first, second = (rolling_hash(x, n // 2, places).astype(U64) for x in (values, finish(values)))
    return ((finish(first).astype(U64) << U64(32) | second) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def _round(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    h = h ^ scramble(k)
    return ((h << U32(13)) | (h >> U32(19))) * U32(5) + U32(ADD)


def scramble(k: np.ndarray) -> np.ndarray:
    k = k * U32(C1)
    return ((k << U32(15)) | (k >> U32(17))) * U32(C2)


def window_murmur3(buffer: np.ndarray, n: int, starts: np.ndarray | None = None, seed: int = WINDOW_SEED) -> np.ndarray:
    """Murmur3 (x86, 32 bits) of buffer[i : i + n] for every start i; n / 4 rounds over all windows. Meant for n up to 256."""
    if starts is None:
        starts = np.arange(max(0, len(buffer) - n + 1))
    b = np.r_[buffer, np.zeros(3, np.uint8)].astype(U32)
    words = b[:-3] | b[1:-2] << U32(8) | b[2:-1] << U32(16) | b[3:] << U32(24)
    h = np.full(len(starts), seed, U32)
    for k in range(n // 4):
        h = _round(h, words[starts + 4 * k])
    if n % 4:
        h = h ^ scramble(words[starts + n - n % 4] & U32((1 << 8 * (n % 4)) - 1))
    return finish(h ^ U32(n & 0xFFFFFFFF))


def murmur3(gram: bytes, seed: int = WINDOW_SEED) -> int:
    return int(window_murmur3(np.frombuffer(gram, np.uint8), len(gram), np.zeros(1, np.int64), seed)[0]) if gram else int(finish(np.array([seed], U32))[0])


#: The modulus of fingerprints, a prime: polynomials over a prime field have no strings that collide for every base.
P61 = (1 << 61) - 1
#: A base for each half of a fingerprint.
BASES = (0x0B4E0EF37BC32127, 0x1F3A5C79D86B2E4D)
U64 = np.uint64


def _mod61(x: np.ndarray) -> np.ndarray:
    x = (x & U64(P61)) + (x >> U64(61))
    return np.where(x >= U64(P61), x - U64(P61), x)


def _mul61(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Products modulo 2 ** 61 - 1 of numbers below it, by halves of 31 bits: no step passes 64 bits."""
    b = np.asarray(b, U64)
    low, mask = U64(31), U64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> low, a & mask, b >> low, b & mask
    mid = a0 * b1 + a1 * b0
    return _mod61(((a1 * b1) << U64(1)) + (mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << low) + a0 * b0)


_known61: dict[int, np.ndarray] = {}


def _powers61(base: int, size: int) -> np.ndarray:
    """base ** 0, 1, ..., size of them at least, doubling what is known each time. One array a base is kept."""
    out = _known61.get(base, np.ones(1, U64))
    while len(out) < size:
        out = np.concatenate([out, _mul61(out, pow(base, len(out), P61))])
    _known61[base] = out
    return out


def fingerprints(buffer: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers below 2 ** 61 that name the n bytes from each start: polynomials at two bases. No work grows with n."""
    if 2 * len(starts) < len(buffer):  # only bytes that windows have; those of a window stay together
        used = np.cumsum(np.bincount(starts, minlength=len(buffer) + 1) - np.bincount(starts + n, minlength=len(buffer) + 1))[:-1] > 0
        buffer, starts = buffer[used], (np.cumsum(used) - 1)[starts]
    size = 1 << max(10, len(buffer).bit_length())
    out = []
    for base in BASES:
        inverse = pow(base, -1, P61)
        term = _mul61(_powers61(base, size)[: len(buffer)], buffer.astype(U64) + U64(1))
        low, high = np.zeros(len(buffer) + 1, U64), np.zeros(len(buffer) + 1, U64)
        np.cumsum(term & U64(0xFFFFFFFF), out=low[1:])
        np.cumsum(term >> U64(32), out=high[1:])
        total = _mod61(_mod61(low[starts + n] - low[starts]) + _mul61(_mod61(high[starts + n] - high[starts]), 1 << 32))
        out.append(_mul61(total, _powers61(inverse, size)[starts]))
    return out[0], out[1]


HASHERS = ("rabin_karp", "murmur3")


def checked_hasher(name: str) -> str:
    if name not in HASHERS:
        raise ValueError(f"unknown hasher {name!r}; there are {', '.join(HASHERS)}")
    return name
