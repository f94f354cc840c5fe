"""Connected components by alternating large and small stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrams.llm.common import cut


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with least: the smallest of u's neighbours."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("least")), "u")


def _state(edges: DataFrame) -> tuple:
    """Tells whether a round changed anything."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any order, repeated or not -> (node, component): each node that has an edge to another, and the
    smallest node that it reaches. The number of rounds grows with the logarithm of the number of nodes."""
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        # large star: larger neighbours of u go to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, go to the least of them
        small = _with_least(large)
        small = small.select("u", F.col("least").alias("v")).unionByName(small.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")))
        now = cut(small.distinct())
        if (new := _state(now)) == state:
            break
        state = new
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
