"""Sparse feature vectors of documents over a profile. The rows of a profile go to every task, and nothing is shuffled; of a
profile that is too large for that a bit map does, and the windows that it lets through are joined with the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bytegrams.functions.bits import bit_map
from bytegrams.functions.grams import content_slice
from bytegrams.operators import scan
from bytegrams.sources.profile import MOST_ROWS, Profile


def vectorize(docs: DataFrame, profile: Profile, values: str = "binary", part: tuple[int, int] | None = None, most: int = MOST_ROWS) -> DataFrame:
    """docs with features struct<size, indices, values> in place of content; other columns stay.

    values "binary": 1 for each feature that a document has; "counts": how
    often. Features whose buckets collide are one index each: hashed
    profiles have distinct buckets, exact ones compare bytes. Empty and null
    contents give zero vectors. part: (offset, length) of the content to use.
    Profiles of more than ``most`` rows are joined by shuffle.
    """
    if values not in ("binary", "counts"):
        raise ValueError(f"unknown values {values!r}")
    spec, size = profile.spec, profile.kept
    if part:
        docs = docs.withColumn("content", content_slice(F.col("content"), *part))
    keep = [c for c in docs.columns if c != "content"]
    if profile.kept > most:
        return _joined(docs, profile, values == "counts", keep)
    rows = profile.rows.collect()
    buckets = np.array([r["bucket"] for r in rows], np.int64)
    order = np.argsort(buckets, kind="stable")
    whitelist, number = buckets[order], np.array([r["feature_idx"] for r in rows], np.int64)[order]
    known = {bytes(r["gram"]): r["feature_idx"] for r in rows} if profile.exact else None
    count_all = values == "counts"

    def each(batch: pa.RecordBatch, buffer: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        w = scan.windows_of(buffer, offsets, spec)
        if known is None:
            at = np.minimum(np.searchsorted(whitelist, w.bucket), max(len(whitelist) - 1, 0))
            ok = whitelist[at] == w.bucket if len(whitelist) else np.zeros(len(w.bucket), bool)
            doc, feature = w.doc[ok], number[at[ok]]
        else:
            w = scan.kept_windows(w, np.unique(whitelist))
            grams, place = np.unique(w.grams(spec.size), return_inverse=True)
            names = np.array([known.get(g.tobytes(), -1) for g in grams], np.int64)
            feature = names[place.ravel()] if len(names) else np.zeros(0, np.int64)
            doc, feature = w.doc[feature >= 0], feature[feature >= 0]
        pairs, count = np.unique(doc * (size + 1) + feature, return_counts=True)
        doc, feature = np.divmod(pairs, size + 1)
        edge = pa.array(np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32))
        amount = count.astype(float) if count_all else np.ones(len(count))
        vector = pa.StructArray.from_arrays([pa.array(np.full(len(offsets) - 1, size, np.int32)), pa.ListArray.from_arrays(edge, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(amount))], ["size", "indices", "values"])
        return [*[batch.column(c) for c in keep], vector]

    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return scan.mapped(docs, keep, f"{types}, features struct<size:int,indices:array<int>,values:array<double>>", each)


def _joined(docs: DataFrame, profile: Profile, count_all: bool, keep: list[str]) -> DataFrame:
    """The same where the profile's rows can't go to every task.

    A document is named by its id and the hash of its content, so repeated
    rows have the same entries; only these two, the entries and the columns to
    keep are shuffled, never contents.
    """
    spec = replace(profile.spec, count_mode="occurrences")
    named = docs.withColumn("named_", F.xxhash64("content"))
    bits = bit_map(profile.rows.select(scan.bucket_hash(F.col("bucket")).alias("hash")), "hash")
    ids = ["doc_id", "named_"]
    if profile.exact:
        key = ["one", "two"]
        entries, rows = scan.part_fingerprints(named, spec, buckets=bits, ids=ids), scan.fingerprinted(profile.rows.select("feature_idx", "gram"), spec.size)
    else:
        key = ["bucket"]
        entries, rows = scan.document_buckets(named, spec, bits, ids), profile.rows
    hits = entries.join(rows.select("feature_idx", *key), key).groupBy(*ids, "feature_idx").agg(F.max("cnt").alias("cnt"))
    value = F.col("cnt").cast("double") if count_all else F.lit(1.0)
    found = hits.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("feature_idx", value.alias("value")))).alias("entries_"))
    found = found.select(F.col("doc_id").alias("id_"), F.col("named_").alias("of_"), "entries_")
    rest = named.select(*keep, "named_")
    joined = rest.join(found, rest["doc_id"].eqNullSafe(found["id_"]) & (rest["named_"] == found["of_"]), "left")
    part = lambda name, kind: F.coalesce(F.transform("entries_", lambda e: e[name]), F.array().cast(f"array<{kind}>"))
    return joined.select(*keep, F.struct(F.lit(profile.kept).alias("size"), part("feature_idx", "int").alias("indices"), part("value", "double").alias("values")).alias("features"))


def long_form(vectors: DataFrame) -> DataFrame:
    """(doc_id, feature_idx, value): a row for each entry that is not zero."""
    pairs = F.arrays_zip("features.indices", "features.values")
    return vectors.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", F.col("x.indices").alias("feature_idx"), F.col("x.values").alias("value"))


def to_ml_vectors(vectors: DataFrame) -> DataFrame:
    """features as sparse vectors of Spark's ML library: the same Arrow columns under its type, batch by batch."""
    from pyspark.ml.linalg import VectorUDT

    names = vectors.columns
    schema = StructType([StructField(f.name, VectorUDT()) if f.name == "features" else f for f in vectors.schema])

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, indices, values = batch.column("features").flatten()
            sparse = pa.StructArray.from_arrays([pa.array(np.zeros(batch.num_rows, np.int8)), size, indices, values], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([sparse if c == "features" else batch.column(c) for c in names], names)

    return vectors.mapInArrow(typed, schema)
