"""The corpus pipeline: stages over documents, each of them one operator.

Every stage takes all that its predecessor kept. The first four return the
columns of documents; each stage's result is written to the shared folder and
read again, so a lost executor costs no more than the stage that it was in.

Stages that run Python bound the bytes of Arrow batches. A stage's plan runs
after the stage returns, so the session keeps the bound; run() takes it back.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrams.llm import bpe, decontaminate, jaccard, secrets, toxicity
from bytegrams.llm.common import BATCH_BYTES, bounded_batches, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on what came in, rejects go."""
    bounded_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    bounded_batches(spark)
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to their kind; every document stays, n_chars follows its text."""
    found, _ = secrets.scan_secrets(docs)
    changed = secrets.redact(docs, found)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    bounded_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("bpe", tokenize),
]

#: A fitted classifier and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done, bounded = None, spark.conf.get(BATCH_BYTES, None) is not None
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if done:
                remove(spark, done)
            done = f"{folder}/{name}"
    finally:
        if not bounded:
            spark.conf.unset(BATCH_BYTES)
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """The folder of a stage that no later one reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
