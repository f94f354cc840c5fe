"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary file is a public tokenizer's JSON: NFC, white space, lower case,
a split into words, bytes as printable characters, merges with a word-end mark.
Code points newer than the installed Unicode tables count as signs. No word
crosses ASCII white space, so a text is the joined codes of its chunks;
the distinct unknown chunks of a batch are encoded together:

* the symbols of all their words lie in one flat array,
* each round finds the rank of every neighbouring pair by binary search over
  the sorted pair keys, and merges in each word the pairs of lowest rank,
* words without a pair left drop out.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from bytegrams.llm.common import texts

SPACE = regex.compile(r"[\x09-\x0D\x20\x85\p{Z}]+")
#: As in the file: contractions, runs of letters, single digits, runs of other signs. \s is spelled out.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\x09-\x0D\x20\x85\p{Z}\p{L}\p{N}]+")
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """One vocabulary. Chunks that are known are kept, at most ``most`` of them."""

    def __init__(self, spec: dict, most: int = 100_000):
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.known: dict[bytes, bytes] = {}
        self.most = most

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (its UTF-8 bytes, one at least)."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        done: list[np.ndarray] = [None] * len(words)
        word = np.repeat(np.arange(len(words)), sizes)  # which word each symbol belongs to
        while len(symbols):
            key = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), NO_RANK, np.int32)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            over = least == NO_RANK
            if over.any():
                cut = np.flatnonzero(over[starts])
                stops = np.r_[starts[1:], len(word)]
                for k in cut:
                    done[word[starts[k]]] = symbols[starts[k] : stops[k]]
                keep = ~over
                symbols, word, rank, least = symbols[keep], word[keep], rank[keep], least[keep]
                if not len(symbols):
                    break
            hit = rank == least
            # in a run of overlapping pairs (a a a), every second one counts, from the left
            run = np.flatnonzero(hit)
            first = np.r_[True, np.diff(run) > 1]
            run = run[(np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))) % 2 == 0]
            symbols[run] = self.merged[rank[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            symbols, word = symbols[keep], word[keep]
        return done

    def learn(self, chunks: list[bytes]) -> None:
        """Encode chunks (UTF-8) that aren't known yet."""
        pieces: list[list] = []  # for each chunk its words and special ids
        index: dict[bytes, int] = {}
        for chunk in chunks:
            own: list = []
            text = chunk.decode()
            for part in self.split_special.split(text) if self.split_special else [text]:
                if part in self.special:
                    own.append(np.array([self.special[part]], np.int32))
                elif part:
                    # letter by letter: a capital sigma at a word's end becomes a plain small one
                    plain = SPACE.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
                    own += [index.setdefault(w.encode(), len(index)) for w in WORD.findall(plain)]
            pieces.append(own)
        coded = self.merge(list(index)) if index else []
        for chunk, own in zip(chunks, pieces, strict=True):
            ids = [x if isinstance(x, np.ndarray) else coded[x] for x in own]
            self.known[chunk] = np.concatenate(ids).astype("<u4").tobytes() if ids else b""

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Each text's (UTF-8) ids as little-endian unsigned 32-bit integers.

        bytes.split() splits at ASCII white space and nowhere else.
        """
        if len(self.known) > self.most:
            self.known.clear()
        known, out, late = self.known, [], []
        for k, text in enumerate(batch):
            chunks = text.split()
            try:
                out.append(b"".join([known[c] for c in chunks]))
            except KeyError:
                out.append(b"")
                late.append((k, chunks))
        if late:
            self.learn(list({c: None for _, chunks in late for c in set(chunks) if c not in known}))
            for k, chunks in late:
                out[k] = b"".join([known[c] for c in chunks])
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with blanks between: the file has no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    with open(path, encoding="utf-8") as f:
        return Bpe(json.load(f))


def _slices(column: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Parts of a column of about so many bytes, a value at least: where each begins, and its values as bytes."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset + 1 : column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        begin = ends[start - 1] if start else np.frombuffer(column.buffers()[1], np.int64)[column.offset]
        stop = max(start + 1, int(np.searchsorted(ends, begin + size, "right")))
        yield start, [x or b"" for x in column.slice(start, stop - start).to_pylist()]
        start = stop


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids binary (little-endian unsigned 32-bit integers).

    vocabulary: the tokenizer's JSON, at a path that every executor has, or a
    name given to SparkContext.addFile. Null and empty texts have no tokens.
    Rows are coded each on their own: repeated rows and ids stay. Very long
    texts are coded whole, split by split. No rows: no rows. Further columns
    are ignored.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary if vocabulary.startswith("/") else SparkFiles.get(vocabulary))
        for batch in batches:
            for start, part in _slices(batch.column(1)):
                ids = bpe.encode(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(coded, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """tokens (doc_id, n_tokens, ids) -> the same and decoded string. Null ids decode to an empty text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary if vocabulary.startswith("/") else SparkFiles.get(vocabulary))
        for batch in batches:
            for start, part in _slices(batch.column("ids")):
                own = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(map(bpe.decode, part), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(read, "doc_id long, n_tokens long, ids binary, decoded string")
