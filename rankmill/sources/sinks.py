"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.functions.text import csv_cell

BOM = "﻿"


def write_csv(df: DataFrame, path: str) -> None:
    """Comma separated files in a folder, RFC quoting. Each partition writes its own
    file, so any size fits; lists must be joined to text before."""
    df.write.mode("overwrite").option("header", "true").option("quote", '"').option(
        "escape", '"'
    ).option("emptyValue", "").csv(path)


def write_bom_csv(df: DataFrame, path: str, order: str) -> None:
    """Text files in a folder that read on from one to the next, sorted by ``order``.

    The first begins with a byte order mark and the header. Range partitions keep the order at any size.
    """
    body = df.select(
        F.lit(1).alias("_part"), F.col(order).cast("long").alias("_o"),
        F.concat_ws(",", *[csv_cell(F.col(c)) for c in df.columns]).alias("value"),
    )
    head = df.sparkSession.createDataFrame(
        [(0, -1, BOM + ",".join(df.columns))], "_part int, _o long, value string"
    )
    head.unionByName(body).orderBy("_part", F.col("_o").asc_nulls_last()).select("value").write.mode("overwrite").text(path)


def write_by_status(df: DataFrame, path: str, status: str = "parse_status") -> None:
    df.write.mode("overwrite").partitionBy(status).parquet(path)


def write_lines(df: DataFrame, path: str, line: str) -> None:
    df.select(F.col(line).alias("value")).write.mode("overwrite").text(path)
