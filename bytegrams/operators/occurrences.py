"""Which documents have which of the given grams: a row for each pair, or posting lists in segments of bounded size."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrams.functions.bits import bit_map
from bytegrams.operators import scan, topk
from bytegrams.operators.scan import GramSpec

#: Document numbers that a segment of a posting list spans.
SEGMENT = 1 << 16


def _hits(docs: DataFrame, grams: DataFrame, spec: GramSpec) -> tuple[DataFrame, DataFrame]:
    """((doc_id, one, two) of the windows that are given grams, once a document; (gram, one, two) of the grams).

    A bit map of the grams' buckets prunes windows before they become rows,
    however many grams there are; fingerprints decide.
    """
    wanted = scan.fingerprinted(scan.hash_grams(grams.select("gram").distinct(), spec), spec.size).filter("one IS NOT NULL")
    bits = bit_map(wanted.select(scan.bucket_hash(F.col("bucket")).alias("hash")), "hash")
    rows = scan.part_fingerprints(docs, replace(spec, count_mode="documents"), buckets=bits, ids=["doc_id"])
    return rows.join(wanted.select("one", "two"), ["one", "two"], "left_semi").select("doc_id", "one", "two").distinct(), wanted.select("gram", "one", "two")


def occurrence_index(docs: DataFrame, grams: DataFrame, spec: GramSpec) -> DataFrame:
    """grams (gram binary) -> (gram, doc_id) for each document that has it.

    The long form needs no group however common a gram is. Null and empty
    contents have no grams; grams of another size are in no document.
    """
    hits, wanted = _hits(docs, grams, spec)
    return hits.join(wanted, ["one", "two"]).select("gram", "doc_id")


def posting_segments(docs: DataFrame, grams: DataFrame, spec: GramSpec, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """((gram, segment, n, places array<int>), (number, doc_id)): posting lists.

    Documents are numbered in the order of their ids. A segment has the
    documents number segment * size to (segment + 1) * size - 1 that have the
    gram, as ascending differences to the first of these, so no row grows with
    the corpus, and Parquet packs the small numbers.
    """
    hits, wanted = _hits(docs, grams, spec)
    numbers = topk.numbered(docs.select("doc_id").distinct(), "number", F.col("doc_id"))
    named = hits.join(numbers, hits["doc_id"].eqNullSafe(numbers["doc_id"])).select("one", "two", F.expr(f"number div {size}").alias("segment"), F.pmod("number", F.lit(size)).cast("int").alias("place"))
    lists = named.groupBy("one", "two", "segment").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("place")).alias("places"))
    return lists.join(wanted, ["one", "two"]).select("gram", "segment", "n", "places"), numbers


def segment_members(segments: DataFrame, numbers: DataFrame, size: int = SEGMENT) -> DataFrame:
    """posting_segments -> (gram, doc_id)."""
    each = segments.select("gram", F.explode(F.transform("places", lambda p: F.col("segment") * size + p)).alias("number"))
    return each.join(numbers, "number").select("gram", "doc_id")
