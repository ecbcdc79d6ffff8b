"""Readers. Schemas come from parquet or are given; nothing is inferred from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions.text import trim_ws

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


PARTS = "rankmill.read.parts"  # session setting: default of ``table``'s ``parts``


def table(spark: SparkSession, folder: str, name: str, parts: int | None = None) -> DataFrame:
    """A table of a folder.

    Files of many row groups are split by the scan itself. For tables of a single row group the caller may ask for
    ``parts`` (or set ``rankmill.read.parts`` in its session): the columns a query needs are then dealt out to that many tasks.
    Without it nothing is shuffled.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = parts or int(spark.conf.get(PARTS, "0"))
    return df.repartition(parts) if parts else df


def pieces(spark: SparkSession, folder: str, name: str, rows: int = 1_200_000) -> int:
    """Number of partitions of about ``rows`` rows that a table is worth, one per core at least.

    The count comes from the footers of the files. For steps that need far more memory than their shuffled rows have
    bytes: Spark joins small partitions up to a size in bytes, which does not bound such a step.
    """
    n = spark.read.parquet(f"{folder}/{name}.parquet").count()
    return max(spark.sparkContext.defaultParallelism, -(-n // rows))


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Name and size of files below a folder; contents stay unread unless asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), "path"
    )


def expected_entries(lines: DataFrame, line: str, order: list[Column], limit: int = 10) -> DataFrame:
    """First entries of an expected list: trimmed, without blanks and # comments."""
    entry = trim_ws(F.col(line))
    return (
        lines.withColumn("entry", entry)
        .where((F.length("entry") > 0) & ~F.col("entry").startswith("#"))
        .orderBy(*order)
        .limit(limit)
    )


def expected_list(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """``expected_entries`` of a text file, in line order."""
    text = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    return expected_entries(text, "value", [F.col("_line")], limit).select("entry")
