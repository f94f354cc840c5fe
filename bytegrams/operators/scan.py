"""The scan that all jobs share: windows of the documents of an Arrow batch, hashed, filtered and combined in numpy
before they become rows. What it returns are ordinary rows; Spark groups, joins and ranks them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrams.functions import hashing
from bytegrams.functions.bits import probed
from bytegrams.functions.grams import auto_stride
from bytegrams.functions.lz import lz_hashes_of

#: Bytes of content that are hashed together.
PART = 4_000_000


@dataclass(frozen=True)
class GramSpec:
    """Which windows are looked at, and how.

    n symbols of width bytes each, or Lempel-Ziv phrases (lz, n = 0). stride:
    only buckets that it divides; 0 means 1. count_mode: "documents" counts a
    bucket or gram once a document, "occurrences" every time.
    """

    n: int = 0
    width: int = 1
    filter_size: int = hashing.FILTER_SIZE
    stride: int = 1
    hasher: str = "rabin_karp"
    count_mode: str = "documents"
    lz: bool = False
    phrases_only: bool = False

    def __post_init__(self):
        if self.lz == (self.n > 0):
            raise ValueError("give a gram size or lz, not both")
        if self.n < 0 or self.stride < 0 or self.filter_size < 1:
            raise ValueError("n and stride can't be negative, filter_size must be positive")
        if self.width not in (1, 2, 4):
            raise ValueError("symbols have 1, 2 or 4 bytes")
        if self.count_mode not in ("documents", "occurrences"):
            raise ValueError(f"unknown count_mode {self.count_mode!r}")
        if hashing.checked_hasher(self.hasher) == "murmur3" and self.width != 1:
            raise ValueError("murmur3 hashes bytes only")

    @property
    def size(self) -> int:
        """Bytes of a gram."""
        return self.n * self.width

    @property
    def step(self) -> int:
        return self.stride or 1


@dataclass
class Windows:
    """Of one part: document number, first byte in the buffer and bucket of each window that the stride keeps."""

    doc: np.ndarray
    start: np.ndarray
    bucket: np.ndarray
    buffer: np.ndarray

    def where(self, keep: np.ndarray) -> Windows:
        return Windows(self.doc[keep], self.start[keep], self.bucket[keep], self.buffer)

    def grams(self, size: int) -> np.ndarray:
        """The windows' bytes, as an array of void items that sort like bytes."""
        if not len(self.start):
            return np.zeros(0, f"V{size}")
        views = np.lib.stride_tricks.sliding_window_view(self.buffer, size)[self.start]
        return np.ascontiguousarray(views).view(f"V{size}").ravel()


def parts(batch: pa.RecordBatch, content: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, buffer, offsets) of about PART bytes each; null contents are empty."""
    column = batch.column(content).cast(pa.large_binary())
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PART, "right")) - 1)
        yield batch.slice(start, stop - start), whole[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        start = stop


def symbols(buffer: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table number of each symbol, first byte of each symbol, number of symbols of each document)."""
    counts = np.diff(offsets) // width
    if width == 1:
        return hashing.symbol_table()[buffer], np.arange(len(buffer)), counts
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(offsets[:-1], counts) + inner * width
    value = np.zeros(len(first), np.uint32)
    for k in range(width):
        value = value << np.uint32(8) | buffer[first + k]
    return (value if width == 4 else hashing.symbol_table(width)[value]), first, counts


def _begins(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, first symbol) of all complete windows."""
    full = np.maximum(counts - n + 1, 0)
    inner = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)
    return np.repeat(np.arange(len(counts)), full), np.repeat(np.cumsum(counts) - counts, full) + inner


#: Grams of so many symbols or more are sieved by anchors, shorter ones by counters.
ANCHORED = 256


@dataclass(frozen=True)
class Sieve:
    """Windows whose anchor is in the bit map ``some``; where head is given, those whose first bytes (heads) are larger must have
    theirs in ``more``."""

    some: np.ndarray
    more: np.ndarray | None = None
    head: int | None = None


def _new(x: np.ndarray) -> np.ndarray:
    """Where another number begins."""
    return np.r_[True, x[1:] != x[:-1]][: len(x)]


def _sieved(sieve: Sieve, values: np.ndarray, first: np.ndarray, begin: np.ndarray, buffer: np.ndarray, spec: GramSpec) -> np.ndarray:
    place = hashing.anchors(values, spec.n)[begin]
    new = _new(place)
    names, number = hashing.anchor_names(values, spec.n, place[new]).view(np.uint64), np.cumsum(new) - 1
    keep = probed(sieve.some, names)[number]
    if sieve.head is not None:
        at = np.flatnonzero(keep & ~probed(sieve.more, names)[number])
        keep[at] = _heads(buffer, first[begin[at]], spec.size) <= sieve.head
    return keep


def document_anchors(buffer: np.ndarray, offsets: np.ndarray, spec: GramSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor, count), once each: the anchors of windows, counted by the places they have. No gram with that anchor
    counts more, as grams at different places have it at different ones."""
    values, _, counts = symbols(buffer, offsets, spec.width)
    doc, begin = _begins(counts, spec.n)
    place = hashing.anchors(values, spec.n)[begin]
    new = _new(place)
    doc, place = doc[new], place[new]
    return _per_document(Windows(doc, place, hashing.anchor_names(values, spec.n, place), buffer), spec)


def windows_of(buffer: np.ndarray, offsets: np.ndarray, spec: GramSpec, sieve: Sieve | None = None) -> Windows:
    """All complete windows of a part whose bucket the stride keeps, and the sieve."""
    if spec.lz:
        hashed, doc = lz_hashes_of(buffer, offsets, spec.phrases_only)
        start = np.zeros(len(doc), np.int64)
    else:
        values, first, counts = symbols(buffer, offsets, spec.width)
        doc, begin = _begins(counts, spec.n)
        if sieve is not None:
            keep = _sieved(sieve, values, first, begin, buffer, spec)
            doc, begin = doc[keep], begin[keep]
        start = first[begin] if len(begin) else begin
        hashed = hashing.rolling_hash(values, spec.n, begin) if spec.hasher == "rabin_karp" else hashing.window_murmur3(buffer, spec.n, start)
    bucket = (hashed % np.uint32(spec.filter_size) if spec.filter_size < 1 << 32 else hashed).astype(np.int64)
    found = Windows(doc, start, bucket, buffer)
    return found if spec.step == 1 else found.where(bucket % spec.step == 0)


def _per_document(w: Windows, spec: GramSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count), once each."""
    order = np.lexsort((w.bucket, w.doc))
    doc, bucket = w.doc[order], w.bucket[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(doc)]) if spec.count_mode == "occurrences" else np.ones(len(at), np.int64)
    return doc[at], bucket[at], count


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place.ravel(), counts, len(unique)).astype(np.int64)


def _binary(grams: np.ndarray, size: int) -> pa.Array:
    raw = pa.py_buffer(np.ascontiguousarray(grams).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(grams), [None, raw]).cast(pa.binary())


def document_grams(w: Windows, spec: GramSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, count), once each."""
    grams, place = np.unique(w.grams(spec.size), return_inverse=True)
    doc, number, count = _per_document(Windows(w.doc, w.start, place.ravel().astype(np.int64), w.buffer), spec)
    return doc, grams[number], count


def mapped(docs: DataFrame, keep: list[str], schema: str, each: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[pa.Array] | None]) -> DataFrame:
    """docs (keep, content) through ``each``, which turns a part into the columns of ``schema``."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buffer, offsets in parts(batch, "content"):
                if columns := each(rows, buffer, offsets):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*keep, "content").mapInArrow(run, schema)


def _type(docs: DataFrame, name: str) -> str:
    return docs.schema[name].dataType.simpleString()


def document_buckets(docs: DataFrame, spec: GramSpec, buckets: np.ndarray | None = None, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc_id, bucket, cnt): rows once a document; cnt is 1 unless occurrences count. buckets: only those in the bit map of
    bucket_hash. ids: other columns in place of doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(buckets)

    def each(rows, buffer, offsets):
        w, kept = windows_of(buffer, offsets, spec), shared.value
        if kept is not None:
            w = w.where(probed(kept, w.bucket.astype(np.uint64) << np.uint64(32)))
        doc, bucket, count = _per_document(w, spec)
        return [*[rows.column(c).take(pa.array(doc)) for c in ids], pa.array(bucket), pa.array(count)]

    return mapped(docs, [*ids], "".join(f"{c} {_type(docs, c)}, " for c in ids) + "bucket long, cnt long", each)


def part_buckets(docs: DataFrame, spec: GramSpec) -> DataFrame:
    """(bucket, cnt) summed over the documents of a part: fewer rows for the shuffle."""

    def each(rows, buffer, offsets):
        _, bucket, count = _per_document(windows_of(buffer, offsets, spec), spec)
        return [pa.array(x) for x in _sum_by(bucket, count)]

    return mapped(docs, [], "bucket long, cnt long", each)


def part_anchors(docs: DataFrame, spec: GramSpec) -> DataFrame:
    """(anchor, cnt) summed over the documents of a part: a row for a quarter of n windows or so."""

    def each(rows, buffer, offsets):
        _, anchor, count = document_anchors(buffer, offsets, spec)
        return [pa.array(x) for x in _sum_by(anchor, count)]

    return mapped(docs, [], "anchor long, cnt long", each)


def anchor_rows(docs: DataFrame, spec: GramSpec) -> DataFrame:
    """(doc_id, anchor): once a row of docs."""

    def each(rows, buffer, offsets):
        doc, anchor, _ = document_anchors(buffer, offsets, spec)
        return [rows.column("doc_id").take(pa.array(doc)), pa.array(anchor)]

    return mapped(docs, ["doc_id"], f"doc_id {_type(docs, 'doc_id')}, anchor long", each)


def kept_windows(w: Windows, whitelist: np.ndarray | None) -> Windows:
    """Windows whose bucket is in the sorted whitelist."""
    if whitelist is None:
        return w
    if not len(whitelist):
        return w.where(np.zeros(len(w.bucket), bool))
    at = np.minimum(np.searchsorted(whitelist, w.bucket), len(whitelist) - 1)
    return w.where(whitelist[at] == w.bucket)


#: Counters of bucket_counters, as a power of two, and how many of them a row of a slab has.
COUNTER_BITS, SLAB_BITS = 24, 16


def counter_hash(bucket: np.ndarray) -> np.ndarray:
    """64-bit hashes whose first bits number a counter."""
    return (bucket.astype(np.uint32) * np.uint32(0x9E3779B1)).astype(np.uint64) << np.uint64(32)


def _slab(number: int, counts: np.ndarray) -> pa.RecordBatch:
    """A slab as a row: the places of counts that aren't 0 (none are named if nearly all are so), and the counts, with four
    bytes each if they fit."""
    kind = np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64
    at = np.flatnonzero(counts)
    places = at.astype(np.uint16).tobytes() if len(at) * 4 < len(counts) * 3 else b""
    held = counts[at] if places else counts
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([places], pa.binary()), pa.array([held.astype(kind).tobytes()], pa.binary())], ["slab", "places", "counts"])


def slab_counts(places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of a row of counter_slabs."""
    n = len(places) // 2 or 1 << SLAB_BITS
    at = np.frombuffer(places, np.uint16).astype(np.int64) if places else np.arange(n)
    return at, np.frombuffer(counts, np.uint32 if len(counts) == 4 * n else np.int64).astype(np.int64)


def _slabs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for number, places, counts in zip(*(batch.column(c).to_pylist() for c in ("slab", "places", "counts")), strict=True):
            yield number, *slab_counts(places, counts)


SLABS = "slab int, places binary, counts binary"


def counter_slabs(docs: DataFrame, spec: GramSpec) -> DataFrame:
    """(slab, places, counts): how many windows each of 2 ** COUNTER_BITS hash classes of buckets has, 2 ** SLAB_BITS of them a
    row (slab_counts reads it). A task adds up its own in one array; no window becomes a row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.uint32)
        windows = 0

        def slabs() -> Iterator[pa.RecordBatch]:
            return (_slab(k, x) for k, x in enumerate(total.reshape(-1, 1 << SLAB_BITS)) if x.any())

        for batch in batches:
            for _, buffer, offsets in parts(batch, "content"):
                place = counter_hash(windows_of(buffer, offsets, spec).bucket) >> np.uint64(64 - COUNTER_BITS)
                if (windows := windows + len(place)) >= 1 << 32:  # before a counter can be full
                    yield from slabs()
                    total[:], windows = 0, len(place)
                np.add.at(total, place.astype(np.int64), np.uint32(1))
        if windows:
            yield from slabs()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for number, at, counts in _slabs_of(batches):
            total.setdefault(number, np.zeros(1 << SLAB_BITS, np.int64))[at] += counts
        for number, counts in total.items():
            yield _slab(number, counts)

    return docs.select("content").mapInArrow(counted, SLABS).repartition("slab").mapInArrow(summed, SLABS)


def largest_counters(slabs: DataFrame, k: int) -> np.ndarray:
    """A bit map of the k largest counters that aren't 0; a slab gives k of its own at most."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, at, counts in _slabs_of(batches):
            first = np.argsort(-counts, kind="stable")[:k]
            first = first[counts[first] > 0]
            yield pa.RecordBatch.from_arrays([pa.array((number << SLAB_BITS) + at[first]), pa.array(counts[first])], ["counter", "cnt"])

    rows = slabs.mapInArrow(best, "counter long, cnt long").orderBy(F.desc("cnt"), "counter").limit(k).select("counter").toArrow()
    return _bits(rows.column("counter").to_numpy())


def counters_reaching(slabs: DataFrame, least: int) -> np.ndarray:
    """A bit map of the counters with ``least`` or more."""

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, at, counts in _slabs_of(batches):
            bits = np.zeros(1 << SLAB_BITS, bool)
            bits[at[counts >= least]] = True
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slab", "bits"])

    out = _bits(np.zeros(0, np.int64))
    each = out.reshape(-1, 1 << (SLAB_BITS - 6))
    for row in slabs.mapInArrow(reached, "slab int, bits binary").collect():  # 2 ** COUNTER_BITS bits in all
        each[row["slab"]] = np.frombuffer(row["bits"], np.uint64)
    return out


def _bits(counters: np.ndarray) -> np.ndarray:
    """A bit map with those counters' bits."""
    out = np.zeros(1 << (COUNTER_BITS - 6), np.uint64)
    np.bitwise_or.at(out, counters >> 6, np.uint64(1) << (counters & 63).astype(np.uint64))
    return out


def fingerprint_groups(w: Windows, spec: GramSpec, by_document: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, its other half, count, number of a window that has it) of the distinct grams among windows, of those of
    each document if by_document."""
    one, two = hashing.fingerprints(w.buffer, spec.size, w.start)
    order = np.argsort(one, kind="stable")  # within a fingerprint documents stay in their order
    same = one[order][1:] == one[order][:-1]
    if (same & (two[order][1:] != two[order][:-1])).any():
        order = np.lexsort((two, one))
    one, two, doc = one[order], two[order], w.doc[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
    first = np.r_[True, new[1:] | (doc[1:] != doc[:-1])]  # of each document
    begin = np.flatnonzero(first if by_document else new)
    count = np.add.reduceat(first if spec.count_mode == "documents" else np.ones(len(one), np.int64), begin, dtype=np.int64)
    return one[begin], two[begin], count, order[begin]


def heads(w: Windows, which: np.ndarray, size: int) -> np.ndarray:
    """The first eight bytes of these windows (zeros after shorter ones) as signed numbers that sort like the bytes."""
    return _heads(w.buffer, w.start[which], size)


def _heads(buffer: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    for k in range(min(size, 8)):
        out |= buffer[start + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def bucket_hash(bucket: Column) -> Column:
    """64-bit hashes of buckets for a bit map: their leading bits."""
    return F.shiftleft(bucket.cast("long"), 32)


def part_fingerprints(docs: DataFrame, spec: GramSpec, whitelist: np.ndarray | None = None, counters: np.ndarray | None = None, buckets: np.ndarray | None = None, ids: Sequence[str] = (), sieve: Sieve | None = None) -> DataFrame:
    """(one, two, bucket, cnt, holder, at, head): the fingerprint of each distinct gram of a part, how often it counts, where it
    stands once: at byte ``at`` of a document whose id has the hash ``holder``, and its first eight bytes as a number that
    sorts like them. No more of a gram's bytes becomes a row.

    Only windows in whitelisted buckets, in those of the two bit maps, of counters and of bucket_hash, and of the sieve. ids:
    columns that come first; then a gram has a row once a document.
    """
    shared = docs.sparkSession.sparkContext.broadcast((whitelist, counters, buckets, sieve))
    docs = docs.withColumn("holder", F.xxhash64("doc_id"))

    def each(rows, buffer, offsets):
        whitelist, counters, buckets, sieve = shared.value
        w = kept_windows(windows_of(buffer, offsets, spec, sieve), whitelist)
        if buckets is not None:
            w = w.where(probed(buckets, w.bucket.astype(np.uint64) << np.uint64(32)))
        if counters is not None:
            w = w.where(probed(counters, counter_hash(w.bucket)))
        if not len(w.start):
            return None
        one, two, count, order = fingerprint_groups(w, spec, bool(ids))
        place = pa.array(w.doc[order])
        bucket, at = pa.array(w.bucket[order]), w.start[order] - offsets[w.doc[order]]
        return [*[rows.column(c).take(place) for c in ids], pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64)), bucket, pa.array(count), rows.column("holder").take(place), pa.array(at), pa.array(heads(w, order, spec.size))]

    types = "".join(f"{c} {_type(docs, c)}, " for c in ids)
    return mapped(docs, [*ids, "holder"], f"{types}one long, two long, bucket long, cnt long, holder long, at long, head long", each)


def fingerprinted(grams: DataFrame, size: int) -> DataFrame:
    """grams (gram, ...) with the fingerprint of each gram in one and two; null for those of another size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [g or b"" for g in batch.column("gram").to_pylist()]
            wrong = np.array([len(g) != size for g in raw], bool)
            starts = np.cumsum([0, *map(len, raw)])[:-1][~wrong]
            halves = []
            for half in hashing.fingerprints(np.frombuffer(b"".join(raw), np.uint8), size, starts):
                x = np.zeros(len(raw), np.int64)
                x[~wrong] = half.astype(np.int64)
                halves.append(pa.array(x, mask=wrong))
            yield pa.RecordBatch.from_arrays([*batch.columns, *halves], [*batch.schema.names, "one", "two"])

    rest = grams.drop("one", "two")
    return rest.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", one long, two long")


def part_grams(docs: DataFrame, spec: GramSpec, whitelist: np.ndarray | None = None) -> DataFrame:
    """(gram, cnt) summed over the documents of a part, of windows in whitelisted buckets."""

    def each(rows, buffer, offsets):
        _, grams, count = document_grams(kept_windows(windows_of(buffer, offsets, spec), whitelist), spec)
        unique, total = _sum_by(grams, count)
        return [_binary(unique, spec.size), pa.array(total)]

    return mapped(docs, [], "gram binary, cnt long", each)


def gram_rows(docs: DataFrame, spec: GramSpec, whitelist: np.ndarray | None = None) -> DataFrame:
    """(doc_id, gram, cnt): once a document, of windows in whitelisted buckets."""

    def each(rows, buffer, offsets):
        doc, grams, count = document_grams(kept_windows(windows_of(buffer, offsets, spec), whitelist), spec)
        return [rows.column("doc_id").take(pa.array(doc)), _binary(grams, spec.size), pa.array(count)]

    return mapped(docs, ["doc_id"], f"doc_id {_type(docs, 'doc_id')}, gram binary, cnt long", each)


def hash_grams(grams: DataFrame, spec: GramSpec, column: str = "gram") -> DataFrame:
    """grams with the bucket of each gram in ``bucket``: the same as its window's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [g or b"" for g in batch.column(column).to_pylist()]
            offsets = np.cumsum([0, *map(len, raw)])
            values, first, counts = symbols(np.frombuffer(b"".join(raw), np.uint8), offsets, spec.width)
            begin = np.cumsum(counts) - counts
            good = counts == spec.n
            out = np.full(len(raw), -1, np.int64)
            hashed = hashing.rolling_hash(values, spec.n, begin[good]) if spec.hasher == "rabin_karp" else np.array([hashing.murmur3(g) for g, ok in zip(raw, good, strict=True) if ok], np.uint32)
            out[good] = hashed % np.uint32(spec.filter_size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "bucket"])

    rest = grams.drop("bucket")
    return rest.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", bucket long")


def with_stride(spec: GramSpec, stride: int | None) -> GramSpec:
    """stride None: a quarter of n."""
    return replace(spec, stride=auto_stride(spec.n) if stride is None else stride)
