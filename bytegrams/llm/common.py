"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark's bound on the bytes of an Arrow batch, and what it is set to.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null texts as empty ones: further columns can't clash with those of an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names for all executors; one of this machine only where all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have about BATCH bytes, unless it has a bound of its own. The number of rows
    bounds no bytes: with long rows a task has several times as much in its buffers, on both sides of the pipe to Python."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bounded_rows(df: DataFrame, most: int) -> bool:
    """Whether df has at most that many rows; reads no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: compressed and by column, where a checkpoint is neither."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """The files that stored() has written, once nothing reads them any more."""
    sc = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = sc._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
