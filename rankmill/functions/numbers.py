"""Rounding rules. Spark's round() differs from half-up on the scaled double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def half_up(value: Column, digits: int = 1) -> Column:
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def round2(value: Column) -> Column:
    """Two decimals, with machine epsilon added first."""
    return F.floor((value + EPSILON) * 100.0 + 0.5) / 100.0


def percentage(earned: Column, possible: Column) -> Column:
    return F.when(
        possible != 0, round2(F.lit(100.0) * earned / F.nullif(possible, F.lit(0).cast("double")))
    ).otherwise(F.lit(0.0))


def ratio_or_zero(value: Column, divisor: Column) -> Column:
    return F.when(divisor > 0, value / F.when(divisor > 0, divisor)).otherwise(F.lit(0.0))
