import numpy as np
import pytest

from bytegrams.functions import hashing
from bytegrams.functions.lz import lz_hashes

M = 0xFFFFFFFF


def plain_murmur3(data, seed):
    """Murmur3 (x86, 32 bits), byte by byte."""
    h = seed
    rot = lambda x, r: (x << r | x >> (32 - r)) & M
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little")
        h = (rot(h ^ rot(k * hashing.C1 & M, 15) * hashing.C2 & M, 13) * 5 + hashing.ADD) & M
    if len(data) > whole:
        h ^= rot(int.from_bytes(data[whole:], "little") * hashing.C1 & M, 15) * hashing.C2 & M
    h ^= len(data)
    h = (h ^ h >> 16) * hashing.MIX1 & M
    h = (h ^ h >> 13) * hashing.MIX2 & M
    return h ^ h >> 16


@pytest.mark.parametrize("n", [1, 4, 8, 64, 1024])
def test_window_alone_decides(n):
    """Bytes 0 to 255 over and over: equal windows have equal hashes wherever they stand."""
    data = np.tile(np.arange(256, dtype=np.uint8), 200)
    values = hashing.symbol_table()[data]
    h = hashing.rolling_hash(values, n)
    assert (h == h[np.arange(len(h)) % 256]).all()
    assert int(h[77]) == hashing.gram_hash(data[77 : 77 + n].tobytes())


def test_rolling_is_whole_gram():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 500).astype(np.uint8)
    for n in (1, 2, 3, 5, 31):
        h = hashing.rolling_hash(hashing.symbol_table()[data], n)
        assert [int(x) for x in h] == [hashing.gram_hash(data[i : i + n].tobytes()) for i in range(500 - n + 1)]
        m = hashing.window_murmur3(data, n)
        assert [int(x) for x in m] == [hashing.murmur3(data[i : i + n].tobytes()) for i in range(500 - n + 1)]


def test_murmur3_published():
    for data, seed, want in [(b"", 0, 0), (b"", 1, 0x514E28B7), (b"\xff\xff\xff\xff", 0, 0x76293B50), (b"!Ce\x87", 0, 0xF55B516B), (b"!Ce", 0, 0x7E4A8634), (b"Hello, world!", 1234, 0xFAF6CDB3), (b"aaaa", 0x9747B28C, 0x5A97808A)]:
        assert hashing.murmur3(data, seed) == want == plain_murmur3(data, seed)


def test_lz_phrases():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 100, 400).tolist())
    seen, phrase, every, whole = set(), b"", [], []
    for k in range(len(data)):
        phrase += data[k : k + 1]
        x = plain_murmur3(phrase, 0)
        every.append(x)
        if len(phrase) > 2 and x not in seen:
            seen.add(x)
            whole.append(x)
            phrase = b""
    assert lz_hashes(data).tolist() == every and lz_hashes(data, True).tolist() == whole
    assert len(lz_hashes(b"")) == 0


def test_unknown_hasher():
    with pytest.raises(ValueError):
        hashing.checked_hasher("crc")
