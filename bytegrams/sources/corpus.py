"""Documents from files and tables: doc_id and content (binary)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrams.sources import ranges

#: Bytes that a row can hold.
MOST_BYTES = (1 << 31) - 1024


def read_corpus(spark: SparkSession, path: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(all files under path, at any depth: doc_id, the file's path, and content; rejects (doc_id, error)).

    A file that can't be read or is larger than ``most`` contributes nothing
    and is a reject; the contents are read again for these. As everywhere in
    Spark, names that start with _ or . are skipped, and symbolic links are as
    the file system gives them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    docs = files.load(path).filter(F.col("length") <= most).select(F.col("path").alias("doc_id"), "content")
    found = files.load(path).select(F.col("path").alias("doc_id"), "length")
    read = docs.filter("content IS NOT NULL").select(F.col("doc_id").alias("read"))
    error = F.when(F.col("length") > most, F.lit("too large")).otherwise("unreadable")
    return docs, found.join(read, F.col("doc_id") == F.col("read"), "left_anti").select("doc_id", error.alias("error"))


def docs_from_table(table: DataFrame, id_column: str, column: str, *keep: str) -> DataFrame:
    """A text or binary column as documents; keep: further columns."""
    content = F.col(column) if table.schema[column].dataType.typeName() == "binary" else F.encode(F.col(column), "utf-8")
    return table.select(F.col(id_column).alias("doc_id"), content.alias("content"), *keep)


def dealt(table: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores, dealt out to all of them: one file can be one partition. Larger
    tables stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def is_gzip(content: Column) -> Column:
    """Whether a header says so: bytes 1f 8b, then a method of 0 to 8."""
    head = F.hex(F.substring(content, 1, 3))
    return F.coalesce((F.length(content) >= 3) & head.startswith("1F8B") & (F.conv(F.substring(head, 5, 2), 16, 10).cast("int") <= 8), F.lit(False))


def decode_gzip(docs: DataFrame, limit: int | None = None, overlap: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents with gzipped contents unpacked, rejects (doc_id, error)).

    A content that can't be unpacked contributes nothing. Contents without the
    header stay as they are, and never leave the JVM. With limit, there are
    the columns chunk_no and chunks, and no row has more than limit + overlap
    bytes: contents are unpacked as rows, in the memory of one.
    """
    keep, most = docs.columns, limit or MOST_BYTES

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                packed = row.column("content")[0].as_buffer()
                blocks = lambda packed=packed: (packed[a : a + ranges.BLOCK].to_pybytes() for a in range(0, packed.size, ranges.BLOCK))
                for chunk_no, chunks, content, error in ranges.unpacked_rows(blocks, most, overlap):
                    if chunks > 1 and not limit:
                        chunk_no, content, error = 0, None, "too large"
                    columns = [pa.array([content], pa.binary()) if c == "content" else row.column(c) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([chunk_no], pa.int32()), pa.array([chunks], pa.int32()), pa.array([error], pa.string())], [*keep, "chunk_no", "chunks", "error"])
                    if error:
                        break

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    packed = is_gzip(F.col("content"))
    unpacked = docs.filter(packed).mapInArrow(unpack, f"{types}, chunk_no int, chunks int, error string")
    plain = docs.filter(~packed)
    plain = split_large(plain, limit, overlap) if limit else plain
    good = unpacked.filter("error IS NULL").drop("error")
    return plain.unionByName(good if limit else good.drop("chunk_no", "chunks")), unpacked.filter("error IS NOT NULL").select("doc_id", "error")


def split_large(docs: DataFrame, limit: int, overlap: int, align: int = 1) -> DataFrame:
    """Rows of at most limit + overlap bytes: documents beyond that become several rows with chunk_no, of ``chunks``.

    overlap is a gram's bytes less one symbol, so every window lies in exactly
    one row; limit is rounded down to whole symbols.
    """
    limit = max(align, limit - limit % align)
    count = F.greatest(F.ceil((F.length("content") - overlap) / limit), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1)
    return docs.withColumn("chunks", F.coalesce(count, F.lit(1))).withColumn("chunk_no", F.explode(starts)).withColumn("content", F.substring("content", F.col("chunk_no") * limit + 1, F.lit(limit + overlap)))
