"""Instants of wall-clock timestamps, whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone that is meant in UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts)
    return F.unix_micros(local.cast("timestamp"))
