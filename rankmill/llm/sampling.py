"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id's digits, modulo 4; fold 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """(doc, y): at most ``limit`` labelled ids outside the held-out fold, by hash order.

    Rows without id or label are left out; of a repeated id the largest label counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return known.orderBy(F.xxhash64("doc"), "doc").limit(limit)
