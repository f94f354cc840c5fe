"""Class labels of corpora: by the place of a corpus, or by a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_two_class(good: DataFrame, bad: DataFrame) -> DataFrame:
    """benign = 0, malicious = 1."""
    return good.withColumn("label", F.lit(0)).unionByName(bad.withColumn("label", F.lit(1)))


def label_multi_class(corpora: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, int]]:
    """Corpora by class name -> (all documents with label, name -> label). Labels follow the names, case ignored."""
    names = sorted(corpora, key=lambda name: (name.lower(), name))
    labels = {name: k for k, name in enumerate(names)}
    whole = None
    for name, k in labels.items():
        one = corpora[name].withColumn("label", F.lit(k))
        whole = one if whole is None else whole.unionByName(one)
    if whole is None:
        raise ValueError("no class is given")
    return whole, labels


def label_by_column(docs: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """docs with label from the distinct values of a column -> (documents, classes (label, name)). Null names are no class
    and their documents have a null label. The classes are few: they are ranked in one task."""
    names = docs.select(F.col(column).cast("string").alias("name")).filter("name IS NOT NULL").distinct()
    classes = names.withColumn("label", F.row_number().over(Window.orderBy(F.lower("name"), "name")) - 1)
    joined = docs.join(classes.withColumnRenamed("name", "__class"), docs[column].cast("string") == F.col("__class"), "left").drop("__class")
    return joined, classes.select("label", "name")
