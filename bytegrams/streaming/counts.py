"""Counts that grow with a corpus: documents are fed batch by batch, the totals are read when wanted.

What was fed lies in segments of summed counts. A new segment is merged with
the one before it as long as it isn't smaller, so there are about as many
segments as the logarithm of what was fed, and a count is written again that
often. A manifest names the segments that count and the batches in them; a new
one takes the place of the last by a rename, so a feed counts wholly or not at
all, and one that is run again counts once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bytegrams.operators import scan
from bytegrams.operators.counts import bucket_counts, merge_counts
from bytegrams.operators.scan import GramSpec
from bytegrams.sources.shared import remove

NONE = {"number": 0, "segments": [], "ranges": [], "names": []}


def _folder(spark: SparkSession, path: str) -> tuple:
    """(Hadoop's path class, the file system of path)."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind, kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict:
    """The last one: number, segments (name and rows), and which batches are in them."""
    kind, store = _folder(spark, path)
    if not store.exists(kind(f"{path}/manifests")):
        return NONE
    names = [f.getPath().getName() for f in store.listStatus(kind(f"{path}/manifests"))]
    last = max((n for n in names if n.isdigit()), default=None, key=int)
    if last is None:
        return NONE
    file = store.open(kind(f"{path}/manifests/{last}"))
    try:
        return json.loads(bytes(file.readAllBytes()))
    finally:
        file.close()


def _swap(spark: SparkSession, path: str, new: dict) -> None:
    """Makes ``new`` the last manifest; an error if another feed was faster."""
    kind, store = _folder(spark, path)
    draft, final = kind(f"{path}/manifests/draft-{uuid.uuid4().hex}"), kind(f"{path}/manifests/{new['number']}")
    file = store.create(draft)
    file.write(bytearray(json.dumps(new).encode()))
    file.close()
    if store.exists(final) or not store.rename(draft, final):
        store.delete(draft, False)
        raise RuntimeError(f"two feeds at a time into {path}")


def has_batch(found: dict, batch: str) -> bool:
    """Numbered batches are kept as ranges, as a stream's are consecutive."""
    return any(a <= int(batch) <= b for a, b in found["ranges"]) if batch.isdigit() else batch in found["names"]


def with_batch(found: dict, batch: str) -> dict:
    if not batch.isdigit():
        return found | {"names": sorted([*found["names"], batch])}
    ranges: list[list[int]] = []
    for a, b in sorted([*found["ranges"], [int(batch)] * 2]):
        if ranges and a <= ranges[-1][1] + 1:
            ranges[-1][1] = max(b, ranges[-1][1])
        else:
            ranges.append([a, b])
    return found | {"ranges": ranges}


def feed(docs: DataFrame, spec: GramSpec, path: str, batch: str) -> None:
    """Count one batch of documents under path. A batch whose name was fed before is the same batch, and counts once."""
    spark = docs.sparkSession
    found = manifest(spark, path)
    if has_batch(found, batch):
        return
    segments, counts = list(found["segments"]), bucket_counts(docs, spec)
    gone: list[str] = []
    while True:
        name = uuid.uuid4().hex
        counts.write.parquet(f"{path}/segments/{name}")
        counts = spark.read.parquet(f"{path}/segments/{name}")
        rows = counts.count()
        if not segments or rows < segments[-1]["rows"]:
            break
        gone += [name, segments[-1]["name"]]
        counts = merge_counts(spark.read.parquet(f"{path}/segments/{segments.pop()['name']}"), counts)
    _swap(spark, path, with_batch(found, batch) | {"number": found["number"] + 1, "segments": [*segments, {"name": name, "rows": rows}], "gone": gone})
    for old in found.get("gone", []):  # the last but one manifest may still be read
        remove(spark, f"{path}/segments/{old}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, cnt) over all batches that were fed: the segments of the last manifest."""
    segments = [spark.read.parquet(f"{path}/segments/{s['name']}") for s in manifest(spark, path)["segments"]]
    return merge_counts(*segments) if segments else spark.createDataFrame([], "bucket long, cnt long")


def feed_stream(docs: DataFrame, spec: GramSpec, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The same for a stream of documents. A batch that is run again after a failure counts once."""
    writer = docs.writeStream.foreachBatch(lambda df, k: feed(df, spec, path, str(k))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_counts(docs: DataFrame, spec: GramSpec) -> DataFrame:
    """The running counts of a stream, for update or complete mode."""
    return scan.part_buckets(docs, spec).groupBy("bucket").agg(F.sum("cnt").alias("cnt"))
