"""Incremental intake: the first holder of a content gives its parsed result to every later copy.

The holders are a table by the first characters of the content hash, appended to once per batch. A batch reads only
the prefixes of its own hashes, and of these only rows of earlier batches, so a replayed batch decides as it did before. New
holders and results are folders of the batch's number, which a replay overwrites.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions.text import near_empty
from rankmill.operators.intake import content_hash
from rankmill.session import cut_lineage
from rankmill.sources.folders import exists

HOLDERS = "content_hash string, holder long, batch long, prefix string"


@dataclass(frozen=True)
class Holders:
    """First holder of each content hash, stored by the first ``prefix`` characters of the hash and by batch."""

    path: str
    prefix: int = 2

    def known(self, spark: SparkSession, prefixes: list[str] | None, before: int) -> DataFrame:
        """(content_hash, holder) of these prefixes (None: all), from batches before ``before``."""
        if not exists(spark, self.path):
            return spark.createDataFrame([], "content_hash string, holder long")
        rows = spark.read.schema(HOLDERS).parquet(self.path)
        wanted = F.lit(True) if prefixes is None else F.col("prefix").isin(prefixes)
        return rows.where(wanted & (F.col("batch") < before)).select("content_hash", "holder")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """``rows``: (content_hash, holder), none of them known before."""
        placed = rows.withColumns({"prefix": F.substring("content_hash", 1, self.prefix), "batch": F.lit(batch_id).cast("long")})
        (
            placed.repartition("prefix").write.partitionBy("prefix", "batch").mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").parquet(self.path)
        )


def first_holders(history: DataFrame, row_id: str, among: DataFrame | None = None) -> DataFrame:
    """(content_hash, holder) of earlier parsed rows: the smallest id of each content.

    ``among``: ids of the rows that count (default: all). They meet hashes, so no text is shuffled.
    """
    held = history.where(~near_empty(F.col("text"))).select(content_hash(F.col("text")).alias("content_hash"), F.col(row_id).cast("long").alias("_id"))
    if among is not None:
        held = held.join(among.select(F.col(row_id).cast("long").alias("_id")), "_id", "left_semi")
    return held.groupBy("content_hash").agg(F.min("_id").alias("holder"))


@dataclass(frozen=True)
class Intake:
    """Sink of a document stream; ``admit`` is its foreachBatch function."""

    holders: Holders
    out: str
    row_id: str

    def admit(self, batch: DataFrame, batch_id: int) -> None:
        """One result row per arrival: content hash, the earlier row whose result it takes over, parse status.

        Of equal contents in one batch the smallest id is the first. Contents that are nearly empty are held by
        nobody, as are rows without an id.
        """
        spark = batch.sparkSession
        rows = batch.select(
            self.row_id, content_hash(F.col("text")).alias("content_hash"), F.coalesce(near_empty(F.col("text")), F.lit(True)).alias("_empty")
        )
        rows = cut_lineage(rows, "arrivals")
        prefixes = rows.agg(F.collect_set(F.substring("content_hash", 1, self.holders.prefix))).first()[0]  # 16 ** prefix at most
        known = self.holders.known(spark, prefixes, batch_id)
        fresh = rows.where(~F.col("_empty")).groupBy("content_hash").agg(F.min(F.col(self.row_id).cast("long")).alias("holder"))
        fresh = cut_lineage(fresh.where("holder IS NOT NULL").join(known, "content_hash", "left_anti"), "first-holders")
        wanted = known.join(rows.select("content_hash").distinct(), "content_hash", "left_semi")
        other = F.when(F.col("holder") != F.col(self.row_id), F.col("holder"))
        status = F.when(F.col("reused_from").isNotNull() | ~F.col("_empty"), "parsed").otherwise("needs_ocr")
        result = rows.join(wanted.unionByName(fresh), "content_hash", "left").withColumn("reused_from", other).select(
            self.row_id, "content_hash", "reused_from", status.alias("parse_status")
        )
        result.write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")
        self.holders.add(fresh, batch_id)

    def results(self, spark: SparkSession, schema: str) -> DataFrame:
        return spark.read.schema(f"{schema}, batch long").parquet(self.out).drop("batch") if exists(spark, self.out) else spark.createDataFrame([], schema)

    def settled(self, spark: SparkSession, schema: str) -> DataFrame:
        """``results`` as one intake of all arrivals would give them, in whatever batches and order they came.

        A content belongs to its holder in the history (batches below 0), or else to the smallest id of all batches. As
        nearly empty contents are held by nobody, the parsed rows are those of the others. Only ids and hashes are read.
        """
        rows = self.results(spark, schema)
        past = self.holders.known(spark, None, 0)
        first = rows.where("parse_status = 'parsed'").groupBy("content_hash").agg(F.min(F.col(self.row_id).cast("long")).alias("holder"))
        owners = past.unionByName(first.join(past, "content_hash", "left_anti"))
        final = rows.drop("reused_from").join(owners, "content_hash", "left")
        return final.withColumn("reused_from", F.nullif(F.col("holder"), F.col(self.row_id))).select(rows.columns)
