"""A table of one row per key that micro-batches merge into.

Each batch writes only the keys it changed, into a folder of its own number; a replayed batch writes the same folder
again. A row carries the number of the batch it comes from and the highest number of a key counts. ``compact`` folds all
finished batches into one base and deletes what it replaces; batches that a base already holds are ignored. So work per batch follows the
changes, not the table, and a job may stop at any point: half-written folders have no success mark and are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.sources.folders import drop_folder, subfolders


@dataclass(frozen=True)
class KeyedTable:
    path: str
    keys: tuple[str, ...]
    schema: str  # DDL of keys and values, without the batch number

    def _numbered(self, spark: SparkSession) -> tuple[int, list[tuple[str, int]]]:
        """Number of the newest base (-1 without one), and all finished folders as (kind, number)."""
        folders = [(kind, int(n)) for kind, _, n in (name.partition("-") for name in subfolders(spark, self.path))]
        return max((n for kind, n in folders if kind == "base"), default=-1), folders

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        """New values of the keys in ``rows``; nothing happens where a base holds the batch already."""
        base, _ = self._numbered(rows.sparkSession)
        if batch_id > base:
            rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/delta-{batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        """One row per key, with the number of the batch that wrote it."""
        base, folders = self._numbered(spark)
        schema = f"{self.schema}, batch long"
        paths = [f"{self.path}/{kind}-{n}" for kind, n in folders if n > base or (kind, n) == ("base", base)]
        if not paths:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(*paths)
        newest = rows.groupBy(*self.keys).agg(F.max("batch").alias("batch"))
        same = [rows[c].eqNullSafe(newest[c]) for c in (*self.keys, "batch")]
        return rows.join(newest, same, "left_semi")

    def compact(self, spark: SparkSession) -> None:
        """Folds all finished batches into one base and deletes the folders it replaces."""
        base, folders = self._numbered(spark)
        newest = max((n for _, n in folders), default=-1)
        if newest > base:
            self.read(spark).write.mode("overwrite").parquet(f"{self.path}/base-{newest}")
        for kind, n in folders:
            if n < newest or kind == "delta":
                drop_folder(spark, f"{self.path}/{kind}-{n}")
