"""Labelled vectors as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def libsvm_lines(vectors: DataFrame) -> DataFrame:
    """vectors (doc_id, label, features) -> (doc_id, value): "label idx:val ...", indices from 1. Whole values have no decimals."""
    entry = lambda i, v: F.concat((i + 1).cast("string"), F.lit(":"), F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string")))
    entries = F.zip_with("features.indices", "features.values", entry)
    return vectors.select("doc_id", F.concat_ws(" ", F.col("label").cast("string"), entries).alias("value"))


def write_libsvm(vectors: DataFrame, path: str) -> None:
    libsvm_lines(vectors).select("value").write.text(path)
