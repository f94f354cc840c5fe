"""The k largest counts, with defined ties and column numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytegrams.sources.shared import stored


def top_buckets(counts: DataFrame, k: int) -> DataFrame:
    """The k buckets of largest count; ties by bucket. Each task sends k rows, nothing is sorted as a whole."""
    return counts.orderBy(F.desc("cnt"), "bucket").limit(k)


def top_grams(counts: DataFrame, k: int, ties: str = "cut") -> DataFrame:
    """The k grams of largest count. ties "cut": by bytes; "keep": all that count as much as the k-th."""
    ordered = counts.orderBy(F.desc("cnt"), "gram").limit(k)
    if ties == "cut":
        return ordered
    if ties != "keep":
        raise ValueError(f"unknown ties {ties!r}")
    least = ordered.agg(F.min("cnt").alias("least"))  # one row
    return counts.join(F.broadcast(least), F.col("cnt") >= F.col("least")).drop("least")


def numbered_buckets(top: DataFrame) -> DataFrame:
    """k rows with feature_idx: from 0 by ascending bucket."""
    return top.withColumn("feature_idx", F.row_number().over(Window.orderBy("bucket")) - 1)


def numbered_grams(top: DataFrame) -> DataFrame:
    """k rows with feature_idx: from 0 by rank."""
    return top.withColumn("feature_idx", F.row_number().over(Window.orderBy(F.desc("cnt"), "gram")) - 1)


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place in that order, from 0, however many there are: they are dealt out by range and sorted part by
    part; only the sizes of the parts meet. Stored, as parts must be the same when they are read again."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(parts.withColumn("part_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part_").count().select("part_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before_"))
    return placed.join(F.broadcast(sizes), "part_").withColumn(name, F.col("before_") + F.col("place_")).drop("part_", "place_", "before_")


def first_rows(counts: DataFrame, k: int, key: str) -> DataFrame:
    """The k rows of largest cnt, ties by key, for any k: the k-th count comes from how many rows have each count, and only
    rows that reach it are put in order."""
    each = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("rows"))  # as many rows as there are different counts
    reached = each.withColumn("so_far", F.sum("rows").over(Window.orderBy(F.desc("cnt")))).filter(F.col("so_far") >= k)
    last = reached.agg(F.max("cnt")).first()[0]
    some = counts.filter(F.col("cnt") >= last) if last is not None else counts
    return numbered(some, "number_", F.desc("cnt"), F.col(key)).filter(F.col("number_") < k).drop("number_")
