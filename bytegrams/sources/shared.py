"""What is stored for a while where all executors can read it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's bound on the bytes of an Arrow batch, and what it is set to.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of the jobs that run inside have about BATCH bytes, unless the session has a bound of its own. The number of
    rows bounds no bytes: a task has what 10,000 documents need several times over, on both sides of the pipe to Python."""
    bounded = spark.conf.get(BATCH_BYTES, None) is not None
    if not bounded:
        spark.conf.set(BATCH_BYTES, BATCH)
    try:
        yield
    finally:
        if not bounded:
            spark.conf.unset(BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names for all executors; one of this machine only where all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet, below the one of this application."""
    return f"{shared_folder(spark)}/{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"stored-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: later jobs neither compute it again nor depend on an executor."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """A folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_stored(spark: SparkSession) -> None:
    """All that this application has stored: for the end of a job, when its results are written."""
    remove(spark, f"{shared_folder(spark)}/{_own(spark)}")
