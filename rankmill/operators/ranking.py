"""Ranks and cuts that hold when one group owns a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Best k rows of each group. The literal bound lets Spark cut every map
    partition to k rows per group before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, as in a window's partitions."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, same, how).drop(*(f"_r_{k}" for k in keys))


def ranked(
    df: DataFrame, group: Sequence[str], score: str, row_id: str, name: str = "rank", shard_rows: int = 4_000_000
) -> DataFrame:
    """Dense position by score descending (null as -1), then id, for all rows.

    A plain window would sort a whole group in one task. Here a group is split by
    score value, and a value with more than ``shard_rows`` rows by id ranges cut at
    measured quantiles, so sparse or hashed ids split as well as dense ones.
    The rows in front of a piece are counted from the table of piece sizes. Sizes
    read group, score and id only; null groups and ids are ranked like any other.
    """
    value = [*group, "_score"]
    piece = [*value, "_shard"]
    scored = df.withColumn("_score", F.coalesce(F.col(score), F.lit(-1.0)))
    cuts = F.percentile_approx(row_id, [i / 256 for i in range(1, 256)], 10_000)
    large = (
        scored.groupBy(*value).agg(F.count(F.lit(1)).alias("_n"), cuts.alias("_cuts"))
        .where(F.col("_n") > shard_rows).drop("_n")
    )
    shard = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(row_id))), F.lit(0))
    pieces = join_same(scored, large, value, "left").withColumn(
        "_shard", F.when(F.col("_cuts").isNull(), 0).otherwise(shard)
    ).drop("_cuts")
    ahead = (
        Window.partitionBy(*group).orderBy(F.col("_score").desc(), F.col("_shard"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = pieces.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n")).select(
        *piece, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*piece).orderBy(row_id)
    return (
        join_same(pieces.withColumn("_local", F.row_number().over(inside)), offsets, piece)
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_score", "_shard", "_before", "_local")
    )


def cap_split(
    df: DataFrame, group: Sequence[str], score: str, row_id: str, cap: int, name: str = "inside"
) -> DataFrame:
    """Flag the first ``cap`` rows of each group; 0 means no cap.

    Only the k-th row of a group is looked up; every row is then compared with
    it, so no group is sorted as a whole. Cut and compare read the same written
    table (see ``ranked``).
    """
    if cap <= 0:
        return df.withColumn(name, F.lit(True))
    key = F.struct(
        (-F.coalesce(F.col(score), F.lit(-1.0))).alias("s"), F.col(row_id).alias("i")
    )
    slim = df.select(*group, key.alias("_key"))
    cut = (
        top_k(slim, group, [F.col("_key")], cap, "_rn")
        .groupBy(*group)
        .agg(F.max("_key").alias("_cut"))
    )
    return join_same(df, cut, list(group)).withColumn(name, key <= F.col("_cut")).drop("_cut")


def running_sum(
    df: DataFrame, key: Sequence[str], bucket: str, order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Running sum per key, split by an order-preserving ``bucket``.

    Sums inside a bucket need one task per (key, bucket); what lies in front of
    the bucket comes from the table of bucket sums.
    """
    inside = Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*key, bucket).agg(F.sum(value).alias("_sum"))
    offsets = sums.select(
        *key, bucket, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before")
    )
    return (
        join_same(df.withColumn("_local", F.sum(value).over(inside)), offsets, [*key, bucket])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_before", "_local")
    )


def previous_value(
    df: DataFrame, key: Sequence[str], bucket: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """lag(value) per key, split by an order-preserving ``bucket``: the first row
    of a bucket takes the last value of the bucket in front of it."""
    inside = Window.partitionBy(*key, bucket).orderBy(*order)
    across = Window.partitionBy(*key).orderBy(bucket)
    tails = df.groupBy(*key, bucket).agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    heads = tails.select(*key, bucket, F.lag("_tail").over(across).alias("_before"))
    rows = df.withColumn("_prev", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    return (
        join_same(rows, heads, [*key, bucket])
        .withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev")))
        .drop("_prev", "_first", "_before")
    )
