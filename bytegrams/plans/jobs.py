"""End-to-end jobs: choose grams, and turn labelled documents into a dataset."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrams.functions.bits import bit_map
from bytegrams.functions.grams import symbol_width
from bytegrams.functions.hashing import FILTER_SIZE
from bytegrams.operators import counts, scan, topk
from bytegrams.operators.scan import GramSpec
from bytegrams.operators.vectors import vectorize
from bytegrams.sources.libsvm import write_libsvm
from bytegrams.sources.profile import MOST_ROWS, ROWS, Profile
from bytegrams.sources.shared import bounded_batches, stored


def _profile(spec: GramSpec, exact: bool, k: int, rows: DataFrame, most: int) -> Profile:
    """The rows are computed here, once: kept by the driver where they are few, and stored in the shared folder else."""
    spark = rows.sparkSession
    rows = rows.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in ROWS.split(", ")])
    if k > most:
        table = stored(rows, "profile")
        kept = table.count()
    else:
        found = rows.collect()
        table, kept = spark.createDataFrame(found, ROWS), len(found)
    if kept < k:
        warnings.warn(f"{kept} of {k} were found", stacklevel=3)
    return Profile(spec, exact, k, table, kept)


def exact_top_grams(docs: DataFrame, spec: GramSpec, k: int, ties: str = "cut", chunked: bool = False) -> DataFrame:
    """(gram, cnt): the k most frequent grams of all, exactly, without counting each gram.

    No gram counts more than the counter that its hash falls into, or, from
    ANCHORED symbols on, than its anchor. Counters are added up without a row
    for each window, anchors with one for many. The grams in the k largest
    give a count that the k-th gram has at least; only grams in those that
    reach it are counted, by fingerprint, and the bytes are fetched for the k
    that come out and for ties at rank k.
    """
    with bounded_batches(docs.sparkSession):
        found = (_found_by_anchors if spec.n >= scan.ANCHORED else _found_by_counters)(docs, spec, k, ties, chunked)
        top = _bytes_of_top(docs, found, spec, k, ties)
    return topk.top_grams(top, k, ties)


def _found_by_counters(docs: DataFrame, spec: GramSpec, k: int, ties: str, chunked: bool) -> DataFrame:
    slabs = scan.counter_slabs(docs, spec).persist()  # asked twice; a lost part is counted again
    try:
        some = counts.fingerprint_counts(docs, spec, counters=scan.largest_counters(slabs, k), chunked=chunked)
        first = some.orderBy(F.desc("cnt")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("cnt").alias("least")).first()
        least = first["least"] if first["n"] == k else 1  # there may be others in any counter
        reaching = scan.counters_reaching(slabs, least)
    finally:
        slabs.unpersist()
    return counts.fingerprint_counts(docs, spec, counters=reaching, min_count=least, chunked=chunked)


#: How many anchors may reach a count, times k, before more are looked at for a better one; how many of the largest then, at most.
WIDER, WIDEST = 64, 1 << 16


def _found_by_anchors(docs: DataFrame, spec: GramSpec, k: int, ties: str, chunked: bool) -> DataFrame:
    """The k best grams known also have first bytes that bound those of others with the same count as the last."""
    named = counts.anchor_counts(docs, spec, chunked).persist()  # asked several times
    in_map = lambda rows: bit_map(rows, "anchor")
    most = k
    try:
        while True:
            largest = named.orderBy(F.desc("cnt"), "anchor").limit(most)
            some = counts.fingerprint_counts(docs, spec, sieve=scan.Sieve(in_map(largest)), chunked=chunked)
            last = F.min(F.struct("cnt", -F.col("head").cast("decimal(20,0)")))
            n, last = some.orderBy(F.desc("cnt"), "head").limit(k).agg(F.count(F.lit(1)), last).first()
            least, head = (last[0], int(-last[1])) if n == k else (1, None)
            below = largest.agg(F.min("cnt")).first()[0] or 0
            if below <= least or most >= WIDEST or named.filter(F.col("cnt") >= least).count() <= WIDER * k:
                break
            most *= WIDER
        reaching = in_map(named.filter(F.col("cnt") >= least))
        more = in_map(named.filter(F.col("cnt") > least)) if ties == "cut" and head is not None else None
    finally:
        named.unpersist()
    sieve = scan.Sieve(reaching, more, None if more is None else head)
    return counts.fingerprint_counts(docs, spec, min_count=least, chunked=chunked, sieve=sieve)


def _bytes_of_top(docs: DataFrame, found: DataFrame, spec: GramSpec, k: int, ties: str) -> DataFrame:
    """(gram, cnt) of the fingerprints that count as much as the k-th; if ties are cut, of those that tie with it only where
    their first bytes may be small enough. So few bytes are fetched, however many grams count the same."""
    found = found.persist()
    try:
        order = [F.desc("cnt"), F.col("head")]
        last = found.orderBy(*order).limit(k).select(F.min(F.struct(F.col("cnt"), -F.col("head").cast("decimal(20,0)"))).alias("x")).select("x.*").first()
        top = found
        if last[0] is not None:
            tied = F.col("cnt") == last[0]
            top = found.filter((F.col("cnt") > last[0]) | (tied if ties == "keep" else tied & (F.col("head") <= int(-last[1]))))
        top = stored(top, "top")
    finally:
        found.unpersist()
    return counts.with_bytes(docs, top, spec)


def select_grams(
    docs: DataFrame, n: int, k: int, stride: int | None = 1, min_count: int = 0, count_mode: str = "documents", hasher: str = "rabin_karp",
    exact: bool = False, filter_size: int = FILTER_SIZE, width: int = 1, ties: str = "cut", chunked: bool = False, most: int = MOST_ROWS,
) -> Profile:
    """The k most frequent grams of n symbols, as a profile.

    One pass counts hashed buckets and keeps the top k. exact: a second pass
    counts the grams in those buckets. With a stride only grams whose bucket
    it divides take part; None is n / 4. Up to ``most`` buckets go to every
    task; of more, only a bit map does, and they are ranked, numbered and
    joined by shuffle. The rows are the same.
    """
    spec = scan.with_stride(GramSpec(n=n, width=width, filter_size=filter_size, hasher=hasher, count_mode=count_mode), stride)
    if filter_size <= k:
        raise ValueError("there must be more buckets than k")
    top = _top_buckets(counts.bucket_counts(docs, spec, min_count, chunked), k, most)
    if not exact:
        return _profile(spec, False, k, _by_bucket(top, k, most), most)
    if k > most:
        found = counts.fingerprint_counts(docs, spec, None, None, min_count, chunked, top)
    else:
        whitelist = np.sort(np.array([r["bucket"] for r in top.select("bucket").collect()], np.int64))
        found = counts.fingerprint_counts(docs, spec, whitelist, None, min_count, chunked)
    grams = _bytes_of_top(docs, found, spec, k, ties)
    if k > most:
        grams = stored(topk.first_rows(grams, k, "gram") if ties == "cut" else grams, "grams")
        rows = topk.numbered(grams, "feature_idx", F.desc("cnt"), F.col("gram"))
    else:
        rows = topk.numbered_grams(topk.top_grams(grams, k, ties))
    return _profile(spec, True, k, scan.hash_grams(rows, spec), most)


def _top_buckets(found: DataFrame, k: int, most: int) -> DataFrame:
    return stored(topk.first_rows(found, k, "bucket"), "buckets") if k > most else topk.top_buckets(found, k)


def _by_bucket(top: DataFrame, k: int, most: int) -> DataFrame:
    rows = topk.numbered(top, "feature_idx", F.col("bucket")) if k > most else topk.numbered_buckets(top)
    return rows.withColumn("gram", F.lit(None).cast("binary"))


def select_symbol_grams(docs: DataFrame, n: int, k: int, alphabet_size: int, stride: int | None = None, min_count: int = 0, count_mode: str = "documents", exact: bool = True, filter_size: int = FILTER_SIZE) -> Profile:
    """Grams of symbols of 1, 2 or 4 bytes, by the size of the alphabet: exact, all ties at rank k, stride n / 4."""
    return select_grams(docs, n, k, stride, min_count, count_mode, exact=exact, filter_size=filter_size, width=symbol_width(alphabet_size), ties="keep")


def select_lz(docs: DataFrame, k: int, min_count: int = 0, stride: int = 1, count_mode: str = "documents", filter_size: int = FILTER_SIZE, phrases_only: bool = False, most: int = MOST_ROWS) -> Profile:
    """The k most frequent Lempel-Ziv phrase hashes; such profiles are always hashed, and n is 0 in them."""
    if filter_size <= k:
        raise ValueError("there must be more buckets than k")
    spec = GramSpec(lz=True, filter_size=filter_size, stride=stride, count_mode=count_mode, phrases_only=phrases_only)
    top = _top_buckets(counts.bucket_counts(docs, spec, min_count), k, most)
    return _profile(spec, False, k, _by_bucket(top, k, most), most)


def build_dataset(docs: DataFrame, profile: Profile, values: str = "binary", path: str | None = None) -> DataFrame:
    """docs (doc_id, content, label) as vectors over a profile; path: also written as libsvm text."""
    vectors = vectorize(docs.select("doc_id", "label", "content"), profile, values)
    if path:
        write_libsvm(vectors, path)
    return vectors
