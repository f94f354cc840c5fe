"""Phrase hashes in the manner of Lempel-Ziv: sequential within a document, documents are independent."""

from __future__ import annotations

import numpy as np

from bytegrams.functions.hashing import ADD, C1, C2, MIX1, MIX2, U32, U64, finish, scramble

M = 0xFFFFFFFF


def lz_hashes(content: bytes, phrases_only: bool = False) -> np.ndarray:
    """The running Murmur3 (seed 0) after each byte, as uint32.

    The current phrase grows by a byte at a time. Once it is longer than two
    bytes and its hash is new in this document, it is complete and the next
    one begins. phrases_only: the hashes of complete phrases.
    """
    out, complete = _running(content)
    return out[complete] if phrases_only else out


def _running(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(running hash, whether a phrase is complete) after each byte."""
    seen: set[int] = set()
    out, ends, h, word, size = [], [], 0, 0, 0
    for b in content:
        word |= b << (8 * (size & 3))
        size += 1
        k = word * C1 & M
        k = (k << 15 | k >> 17) * C2 & M
        x = h ^ k
        if not size & 3:
            x = ((x << 13 | x >> 19) & M) * 5 + ADD & M
            h, word = x, 0
        x ^= size
        x = (x ^ x >> 16) * MIX1 & M
        x = (x ^ x >> 13) * MIX2 & M
        x ^= x >> 16
        if complete := size > 2 and x not in seen:
            seen.add(x)
            h = word = size = 0
        out.append(x)
        ends.append(complete)
    return np.array(out, np.uint32), np.array(ends, bool)


class Seen:
    """A set of 64-bit keys, none of them 0: an open table, asked and filled for many keys at once."""

    def __init__(self, room: int):
        bits = max(4, (2 * room).bit_length())
        self.table, self.shift, self.mask = np.zeros(1 << bits, np.uint64), np.uint64(64 - bits), (1 << bits) - 1

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Whether each of these different keys is new."""
        new = np.zeros(len(keys), bool)
        todo = np.arange(len(keys))
        slot = (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        while len(todo):
            own, at = keys[todo], slot[todo]
            free = self.table[at] == 0
            self.table[at[free]] = own[free]  # of several that want a place one gets it
            there = self.table[at] == own
            new[todo[there & free]] = True
            todo = todo[~there]
            slot[todo] = slot[todo] + 1 & self.mask
        return new


#: What a step for all documents costs, in bytes of a document that is done alone.
STEP = 100


def lz_hashes_of(buffer: np.ndarray, offsets: np.ndarray, phrases_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number): lz_hashes of the documents buffer[offsets[k] : offsets[k + 1]].

    All documents advance together, a byte a step; those that are so much
    longer than the others that steps would be for few are done alone.
    """
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    ordered = size[order]
    alone = int(np.argmin(np.r_[0, np.cumsum(ordered)] + STEP * np.r_[ordered, 0])) if len(size) else 0
    out, complete = np.zeros(int(offsets[-1]), np.uint32), np.zeros(int(offsets[-1]), bool)
    for d in order[:alone].tolist():
        a, b = int(offsets[d]), int(offsets[d + 1])
        out[a:b], complete[a:b] = _running(buffer[a:b].tobytes())
    doc, rest = order[alone:], ordered[alone:]
    start, name = offsets[doc], (doc.astype(np.uint64) + U64(1)) << U64(32)
    seen = Seen(int(rest.sum()) // 3 + 1)
    h, word, length = np.zeros(len(doc), U32), np.zeros(len(doc), U32), np.zeros(len(doc), U32)
    for t in range(int(rest[0]) if len(rest) else 0):
        n = int(np.searchsorted(-rest, -t))  # documents of more bytes
        h, word, length = h[:n], word[:n], length[:n]
        word |= buffer[start[:n] + t].astype(U32) << (U32(8) * (length & U32(3)))
        length += U32(1)
        x = h ^ scramble(word)
        full = length & U32(3) == 0
        x = np.where(full, (x << U32(13) | x >> U32(19)) * U32(5) + U32(ADD), x)
        h[full], word[full] = x[full], 0
        x = finish(x ^ length)
        asks = np.flatnonzero(length > 2)
        done = asks[seen.add(name[asks] | x[asks])]
        h[done] = word[done] = length[done] = 0
        out[start[:n] + t] = x
        complete[start[done] + t] = True
    names = np.repeat(np.arange(len(size)), size)
    return (out[complete], names[complete]) if phrases_only else (out, names)
