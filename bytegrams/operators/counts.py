"""Counts of buckets and grams over a corpus. docs have doc_id and content (binary)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrams.functions.bits import bit_map
from bytegrams.operators import scan
from bytegrams.operators.scan import GramSpec


def bucket_counts(docs: DataFrame, spec: GramSpec, min_count: int = 0, chunked: bool = False) -> DataFrame:
    """(bucket, cnt) over all documents.

    Counts are summed in numpy for each part of a batch, then by Spark before
    and after the shuffle, so a hot bucket is a row a task. chunked: a
    document may be several rows; then buckets that count once a document are
    made distinct by document first, for documents that have several rows.
    """
    whole, split = divided(docs, spec, chunked)
    rows = scan.part_buckets(whole, spec) if whole else None
    if split:
        each = scan.document_buckets(split, spec).groupBy("doc_id", "bucket").agg(F.lit(1).cast("long").alias("cnt")).select("bucket", "cnt")
        rows = rows.unionByName(each) if rows else each
    return at_least(rows.groupBy("bucket").agg(F.sum("cnt").alias("cnt")), min_count)


def divided(docs: DataFrame, spec: GramSpec, chunked: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """(documents of one row, rows of documents of several) where that makes a difference. Without a column ``chunks``, which
    split_large makes, any document may have several."""
    if not chunked or spec.count_mode != "documents":
        return docs, None
    if "chunks" not in docs.columns:
        return None, docs
    return docs.filter("chunks = 1"), docs.filter("chunks > 1")


def gram_counts(docs: DataFrame, spec: GramSpec, whitelist: np.ndarray | None = None, min_count: int = 0, chunked: bool = False) -> DataFrame:
    """(gram, cnt): exact counts of the grams whose bucket is in whitelist (sorted), or of all grams.

    With min_count, windows in counters that don't reach it are left out of
    the shuffle, and the grams' bytes are fetched for those that do. Without,
    all grams are asked for, and their bytes are the keys.
    """
    if spec.lz:
        raise ValueError("phrases have no exact grams")
    if min_count > 1:
        slabs = scan.counter_slabs(docs, spec)
        return with_bytes(docs, fingerprint_counts(docs, spec, whitelist, scan.counters_reaching(slabs, min_count), min_count, chunked), spec)
    whole, split = divided(docs, spec, chunked)
    rows = scan.part_grams(whole, spec, whitelist) if whole else None
    if split:
        each = scan.gram_rows(split, spec, whitelist).groupBy("doc_id", "gram").agg(F.lit(1).cast("long").alias("cnt")).select("gram", "cnt")
        rows = rows.unionByName(each) if rows else each
    return at_least(rows.groupBy("gram").agg(F.sum("cnt").alias("cnt")), min_count)


def anchor_counts(docs: DataFrame, spec: GramSpec, chunked: bool = False) -> DataFrame:
    """(anchor, cnt) over all documents: no gram counts more than its anchor."""
    whole, split = divided(docs, spec, chunked)
    rows = scan.part_anchors(whole, spec) if whole else None
    if split:
        each = scan.anchor_rows(split, spec).groupBy("doc_id", "anchor").agg(F.lit(1).cast("long").alias("cnt")).select("anchor", "cnt")
        rows = rows.unionByName(each) if rows else each
    return rows.groupBy("anchor").agg(F.sum("cnt").alias("cnt"))


def _place() -> list[Column]:
    """Where a gram stands: one of its rows gives all three."""
    return [F.first(c).alias(c) for c in ("holder", "at", "head")]


def fingerprint_counts(docs: DataFrame, spec: GramSpec, whitelist: np.ndarray | None = None, counters: np.ndarray | None = None, min_count: int = 0, chunked: bool = False, buckets: DataFrame | None = None, sieve: scan.Sieve | None = None) -> DataFrame:
    """(one, two, cnt, holder, at, head): exact counts of grams by their fingerprints of 122 bits, each with a place where it
    stands and its first bytes. A row has the same few bytes for any gram size.

    buckets: any number of them, in place of whitelist; a bit map of them prunes windows, and a join by shuffle decides.
    """
    bits = bit_map(buckets.select(scan.bucket_hash(F.col("bucket")).alias("hash")), "hash") if buckets else None
    whole, split = divided(docs, spec, chunked)
    rows = scan.part_fingerprints(whole, spec, whitelist, counters, bits, sieve=sieve) if whole else None
    if split:
        each = scan.part_fingerprints(split, spec, whitelist, counters, bits, ["doc_id"], sieve)
        each = each.groupBy("doc_id", "one", "two").agg(F.first("bucket").alias("bucket"), F.lit(1).cast("long").alias("cnt"), *_place()).drop("doc_id")
        rows = rows.unionByName(each) if rows else each
    if buckets:
        rows = rows.join(buckets.select("bucket"), "bucket", "left_semi")
    return at_least(rows.groupBy("one", "two").agg(F.sum("cnt").alias("cnt"), *_place()), min_count)


#: Grams whose places may be broadcast: 40 bytes each.
MOST_PLACES = 200_000


def with_bytes(docs: DataFrame, found: DataFrame, spec: GramSpec) -> DataFrame:
    """fingerprint_counts -> (gram, cnt): the bytes are read where a gram stands, and hashed again, so a document that only
    shares the hash of an id, or another row of the same id, gives nothing."""
    small = found.limit(MOST_PLACES + 1).count() <= MOST_PLACES
    wanted = found.groupBy("holder").agg(F.collect_list(F.struct("one", "two", "cnt", "at")).alias("wanted"))
    named = docs.select(F.xxhash64("doc_id").alias("holder"), "content").join(F.broadcast(wanted) if small else wanted, "holder")
    cut = lambda x: F.struct(x["one"].alias("known"), x["two"].alias("known2"), x["cnt"].alias("cnt"), F.substring("content", x["at"].cast("int") + 1, F.lit(spec.size)).alias("gram"))
    each = named.select(F.explode(F.transform("wanted", cut)).alias("x")).select("x.*").filter(F.length("gram") == spec.size)
    true = scan.fingerprinted(each, spec.size).filter("one = known AND two = known2")
    return true.dropDuplicates(["one", "two"]).select("gram", "cnt")


def at_least(counts: DataFrame, min_count: int) -> DataFrame:
    return counts.filter(F.col("cnt") >= min_count) if min_count > 0 else counts


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Counts of several batches of documents as those of all of them; bucket or gram counts."""
    key = counts[0].columns[0]
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy(key).agg(F.sum("cnt").alias("cnt"))
