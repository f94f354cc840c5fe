"""Profiles: the chosen buckets or grams with the settings that they were found with."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrams.operators import scan
from bytegrams.operators.scan import GramSpec

ROWS = "feature_idx int, bucket long, gram binary, cnt long"
#: Rows of a profile that go to every task; larger ones are joined.
MOST_ROWS = 2_000_000


@dataclass(frozen=True)
class Profile:
    """rows: feature_idx, bucket, gram (null in hashed profiles), cnt. kept: how many rows there are; wanted: how many were asked for."""

    spec: GramSpec
    exact: bool
    wanted: int
    rows: DataFrame
    kept: int

    @property
    def missing(self) -> int:
        """How many fewer were found than asked for."""
        return max(0, self.wanted - self.kept)

    def facts(self) -> dict:
        """The settings: gram size, how many rows there are, filter size and the rest."""
        return asdict(self.spec) | {"kind": "exact" if self.exact else "hashed", "wanted": self.wanted, "kept": self.kept}


def save_profile(profile: Profile, path: str) -> None:
    """Parquet under path: params (one row) and rows."""
    spark = profile.rows.sparkSession
    spark.createDataFrame([(json.dumps(profile.facts()),)], "params string").coalesce(1).write.parquet(f"{path}/params")
    rows = profile.rows.select("feature_idx", "bucket", "gram", "cnt")
    (rows.coalesce(1) if profile.kept <= MOST_ROWS else rows).write.parquet(f"{path}/rows")


def load_profile(spark: SparkSession, path: str) -> Profile:
    """A saved profile; the buckets of exact grams are computed again."""
    facts = json.loads(spark.read.parquet(f"{path}/params").first()[0])
    kind, wanted, kept = facts.pop("kind", None), facts.pop("wanted"), facts.pop("kept")
    if kind not in ("hashed", "exact"):
        raise ValueError(f"unknown kind of profile: {kind!r}")
    spec = GramSpec(**facts)
    rows = spark.read.parquet(f"{path}/rows")
    if kind == "exact":
        rows = scan.hash_grams(rows, spec)
    return Profile(spec, kind == "exact", wanted, rows.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in ROWS.split(", ")]), kept)
