"""Heavy hitters in bounded memory: with guaranteed bounds, and with Spark's sketch functions.

Spark's functions take strings and tell an estimate: meant for short grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrams.functions.grams import byte_grams, gram_to_hex
from bytegrams.operators import scan
from bytegrams.operators.counts import with_bytes
from bytegrams.operators.scan import GramSpec
from bytegrams.sources.shared import stored

#: Summaries that are merged to one in a task.
FAN = 8
FIELDS = ("one", "two", "cnt", "holder", "at")
SUMMARY = "node int, total long, error long, " + ", ".join(f"{f} array<long>" for f in FIELDS)


class Summary:
    """Counters of at most ``room`` grams between two calls of ``shrink``. A gram counts its counter at least, and at most
    ``error`` more, also where it has no counter; error is at most total / (room + 1)."""

    def __init__(self, room: int):
        self.room, self.total, self.error = room, 0, 0
        self.columns = [np.zeros(0, np.int64) for _ in FIELDS]
        self.held: list[list[np.ndarray]] = []

    def add(self, columns: list[np.ndarray], total: int, error: int = 0) -> None:
        self.total, self.error = self.total + total, self.error + error
        self.held.append(columns)
        if sum(len(c[0]) for c in self.held) > 4 * self.room:
            self.shrink()

    def shrink(self) -> None:
        """Equal grams are added up. If there are too many, the first count beyond the room is taken from all."""
        one, two, cnt, holder, at = (np.concatenate(x) for x in zip(self.columns, *self.held, strict=True))
        self.held = []
        if len(one):
            order = np.lexsort((two, one))
            begin = np.flatnonzero(np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
            first = order[begin]
            one, two, cnt, holder, at = one[first], two[first], np.add.reduceat(cnt[order], begin), holder[first], at[first]
        if len(cnt) > self.room:
            cut = int(np.partition(cnt, len(cnt) - self.room - 1)[len(cnt) - self.room - 1])
            cnt, self.error = cnt - cut, self.error + cut
        keep = cnt > 0
        self.columns = [x[keep] for x in (one, two, cnt, holder, at)]

    def row(self, node: int) -> pa.RecordBatch:
        self.shrink()
        numbers = [pa.array([node], pa.int32()), pa.array([self.total], pa.int64()), pa.array([self.error], pa.int64())]
        return pa.RecordBatch.from_arrays([*numbers, *[pa.array([c], pa.list_(pa.int64())) for c in self.columns]], ["node", "total", "error", *FIELDS])


def gram_summaries(docs: DataFrame, spec: GramSpec, room: int) -> DataFrame:
    """A row with a summary for each task, made in the scan; no gram becomes a row."""
    docs = docs.select(F.xxhash64("doc_id").alias("holder"), "content")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(room)
        for batch in batches:
            for rows, buffer, offsets in scan.parts(batch, "content"):
                w = scan.windows_of(buffer, offsets, spec)
                if len(w.start):
                    one, two, count, at = scan.fingerprint_groups(w, spec)
                    own.add([one.astype(np.int64), two.astype(np.int64), count, rows.column("holder").to_numpy()[w.doc[at]], w.start[at] - offsets[w.doc[at]]], int(count.sum()))
        yield own.row(TaskContext.get().partitionId())

    return docs.mapInArrow(summed, SUMMARY)


def merged_summary(summaries: DataFrame, room: int, fan: int = FAN) -> DataFrame:
    """Summaries as one row, ``fan`` at a time: no task holds more than that many, however many there are."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, Summary] = {}
        for batch in batches:
            for k, node in enumerate(batch.column("node").to_pylist()):
                own = nodes.setdefault(node, Summary(room))
                own.add([batch.column(f)[k].values.to_numpy() for f in FIELDS], batch.column("total")[k].as_py(), batch.column("error")[k].as_py())
        for node, own in nodes.items():
            yield own.row(node)

    rows = stored(summaries, "summaries")
    most = rows.agg(F.max("node")).first()[0] or 0
    while most > 0:
        most //= fan
        rows = rows.withColumn("node", F.expr(f"cast(node div {fan} as int)")).repartition(most + 1, "node").mapInArrow(summed, SUMMARY)
    return rows


def heavy_grams(docs: DataFrame, spec: GramSpec, room: int) -> DataFrame:
    """(gram, lower, upper): grams with guaranteed bounds of their counts, from counters for ``room`` grams.

    Every gram that counts more than total / (room + 1) is there, where total
    is what all grams count together. Bytes are fetched for the grams that
    are there. Null and empty contents have none; no grams: no rows.
    """
    summary = stored(merged_summary(gram_summaries(docs, spec, room), room), "summary")
    pairs = F.arrays_zip(*[F.col(f) for f in FIELDS])
    found = summary.select(F.explode(pairs).alias("x")).select(*[F.col(f"x.{f}").alias(f) for f in FIELDS])
    return with_bytes(docs, found, spec).join(F.broadcast(summary.select("error"))).select("gram", F.col("cnt").alias("lower"), (F.col("cnt") + F.col("error")).alias("upper"))


def _grams(docs: DataFrame, n: int) -> DataFrame:
    distinct = F.array_distinct(byte_grams(F.col("content"), n))
    return docs.select(F.explode(distinct).alias("gram")).select(gram_to_hex(F.col("gram")).alias("gram_hex"))


def _items(sketched: DataFrame, expression: str) -> DataFrame:
    return sketched.select(F.explode(F.expr(expression)).alias("x")).select(F.col("x.item").alias("gram_hex"), F.col("x.count").alias("estimate"))


def approx_top_grams(docs: DataFrame, n: int, k: int, max_items: int | None = None) -> DataFrame:
    """(gram_hex, estimate) of about the k grams that most documents have; max_items (2 k by default) are tracked.

    Estimates are what the sketch says; heavy_grams has bounds.
    """
    most = max_items or 2 * k
    return _items(_grams(docs, n).agg(F.expr(f"approx_top_k(gram_hex, {k}, {most})").alias("top")), "top")


def summarize(docs: DataFrame, n: int, max_items: int) -> DataFrame:
    """One row with a mergeable summary of the corpus."""
    return _grams(docs, n).agg(F.expr(f"approx_top_k_accumulate(gram_hex, {max_items})").alias("summary"))


def merge_summaries(summaries: DataFrame, max_items: int) -> DataFrame:
    """Rows with summaries as one row."""
    return summaries.agg(F.expr(f"approx_top_k_combine(summary, {max_items})").alias("summary"))


def estimate(summary: DataFrame, k: int) -> DataFrame:
    return _items(summary, f"approx_top_k_estimate(summary, {k})")
