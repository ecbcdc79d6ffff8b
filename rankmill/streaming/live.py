"""Stream sources, live counters and throughput over time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankmill.session import shared_folder
from rankmill.sources.folders import is_folder
from rankmill.streaming.keyed_table import KeyedTable

MAX_BATCH = 256 * 1024 * 1024


def read_new_files(spark: SparkSession, path: str, schema, name: str = "*.parquet", **limit: str | int) -> DataFrame:
    """New parquet files below a path as a stream. A batch takes at most 256 MB of
    files (or another ``limit``), so a backlog arrives in bounded pieces."""
    bound = limit or {"maxBytesPerTrigger": MAX_BATCH}
    return spark.readStream.schema(schema).options(pathGlobFilter=name, **bound).parquet(path)


def read_table_as_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream source, one file or a folder of files; only that table is picked up."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if is_folder(spark, path):
        return read_new_files(spark, path, schema, "*")
    return read_new_files(spark, folder, schema, f"{name}.parquet")


def counters(rows: DataFrame, job: str, status: str, values: list[str]) -> DataFrame:
    """Running counters per job; same result as the batch aggregate."""
    return rows.groupBy(job).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values],
    )


def throughput(rows: DataFrame, ts: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Items and tokens per time window, emitted once the watermark has closed the window. ``ts`` must be a timestamp."""
    return (
        rows.withWatermark(ts, late)
        .groupBy(F.window(ts, width))
        .agg(F.count(F.lit(1)).alias("items"), F.sum(value).alias("tokens"))
        .select(F.col("window.start").alias("hour"), "items", "tokens")
    )


def run_available(stream: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Process what is there, then stop: the appended rows, and the folder of the query's progress and state."""
    spark = stream.sparkSession
    out, progress = shared_folder(spark, f"{label}-out"), shared_folder(spark, f"{label}-progress")
    append_available(stream, out, progress)
    return spark.read.schema(stream.schema).parquet(out), progress


def append_available(stream: DataFrame, out: str, progress: str) -> None:
    """Appends to ``out``; with the same ``progress`` a restart goes on where the last run ended."""
    writer = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).outputMode("append")
    writer.format("parquet").option("path", out).start().awaitTermination()


def merge_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], progress: str, mode: str = "append") -> None:
    """Hands every batch with its number to ``sink``, which must take a replayed batch."""
    writer = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).outputMode(mode)
    writer.foreachBatch(sink).start().awaitTermination()


def live_counters(rows: DataFrame, job: str, status: str, values: list[str], table: KeyedTable, progress: str) -> None:
    """Counters per job in update mode: each batch merges the jobs it changed."""
    merge_available(counters(rows, job, status, values), table.merge, progress, "update")
    table.compact(rows.sparkSession)


def open_windows(spark: SparkSession, progress: str) -> DataFrame:
    """Windows of ``throughput`` that the watermark has not closed, as they stand in the state of a stopped query."""
    state = spark.read.format("statestore").load(progress)
    return state.select(F.col("key.window.start").alias("hour"), F.col("value.count").alias("items"), F.col("value.sum").alias("tokens"))


@dataclass(frozen=True)
class LateRows:
    """Side table of the rows that came after their window was closed; ``put`` is a foreachBatch function.

    Fed by the same source, with the same limits per batch, as ``throughput``. A window is closed to arrivals of a batch once
    the newest event of all batches but the one before it, less ``late``, has passed its end; that event's time is kept per
    batch, so a replayed batch decides as before and overwrites its own rows.
    """

    path: str
    ts: str
    width: str = "1 hour"
    late: str = "1 hour"

    def put(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.agg(F.max(F.date_trunc("millisecond", self.ts)).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{self.path}/newest/batch={batch_id}")
        seen = spark.read.schema("newest timestamp, batch long").parquet(f"{self.path}/newest").where(F.col("batch") <= batch_id - 2)
        closed = seen.agg((F.max("newest") - F.expr(f"INTERVAL {self.late}")).alias("_closed"))
        end = F.window(self.ts, self.width)["end"]
        behind = batch.withColumn("_end", end).join(F.broadcast(closed), F.col("_end") <= F.col("_closed"))  # one row
        behind.drop("_end", "_closed").write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{self.path}/rows")
