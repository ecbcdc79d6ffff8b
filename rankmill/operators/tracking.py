"""Run counters, stages, throughput, remaining work and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.numbers import half_up
from rankmill.operators.ranking import running_sum

# Stage and reason texts.
STOPPED = "not_screened_time_budget"
TIME_BUDGET_REASON = "Stopped at the time budget"
CAP_REASON = "Outside Pass A cap"
FAIL_PREFIX = "Turbo LLM failed; Pass A kept. "
STAGE_COUNTERS = {
    "pending": "pending", "extracted": "extracted", "scored": "scored",
    "failed": "failed", "not_screened": STOPPED,
}


def stage_counters(rows: DataFrame, job: str | Sequence[str]) -> DataFrame:
    """``rows``: job, parse_status, stage_status. One combined aggregate."""
    keys = [job] if isinstance(job, str) else list(job)
    parsed = F.col("parse_status") == "parsed"
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(parsed).alias("parsed"),
        *[
            F.count_if(parsed & (F.col("stage_status") == value)).alias(name)
            for name, value in STAGE_COUNTERS.items()
        ],
        F.count_if(F.col("parse_status") == "needs_ocr").alias("needs_ocr"),
        F.count_if(F.col("parse_status") == "error").alias("parse_errors"),
    )


def stage(
    status: Column, pending: Column, extracted: Column, scored: Column,
    two_pass: Column, turbo: Column, not_screened: Column,
) -> Column:
    return (
        F.when((status == "done") & (not_screened > 0), "partial")
        .when(status.isin("done", "partial", "cancelled", "failed", "draft", "queued"), status)
        .when(turbo & (pending == 0) & (extracted > 0), "enrich")
        .when(turbo, "turbo")
        .when(pending > 0, "extracting")
        .when(extracted > 0, "scoring")
        .when(two_pass & (scored > 0), "rescoring")
        .otherwise("scoring")
    )


def display_status(status: Column, not_screened: Column) -> Column:
    return F.when((status == "done") & (not_screened > 0), "partial").otherwise(status)


def resumable(error: Column) -> Column:
    return F.coalesce((error == TIME_BUDGET_REASON) | error.startswith(FAIL_PREFIX), F.lit(False))


def deadline(started: Column, minutes: int) -> Column:
    return started + F.make_interval(mins=F.lit(minutes))


def rate_per_minute(done: Column, elapsed_ms: Column) -> Column:
    ok = (done > 0) & (elapsed_ms > 0)
    return F.when(ok, half_up(done / (F.when(ok, elapsed_ms) / 60000.0), 1)).otherwise(0.0)


def tokens_per_second(tokens: Column, elapsed_ms: Column) -> Column:
    ok = (tokens > 0) & (elapsed_ms > 0)
    return F.when(ok, half_up(tokens / (F.when(ok, elapsed_ms) / 1000.0), 1)).otherwise(0.0)


def queue_size(pending: Column, not_screened: Column, turbo: Column) -> Column:
    return F.when(turbo, pending).otherwise(pending + not_screened)


def minutes_left(remaining: Column, rate: Column) -> Column:
    return F.when(rate > 0, half_up(remaining / F.when(rate > 0, rate), 1))


def percent_done(handled: Column, parsed: Column) -> Column:
    return F.floor(handled / F.greatest(parsed, F.lit(1)) * 100.0 + 0.5)


def best_setting(samples: DataFrame, group: Sequence[str]) -> DataFrame:
    """Setting with the highest rate; the first one wins a tie."""
    return samples.groupBy(*group).agg(
        F.max_by("setting", F.struct(F.col("rate"), -F.col("pos"))).alias("setting"),
        F.max("rate").alias("rate"),
    )


def over_budget(
    rows: DataFrame, key: Sequence[str], bucket: str, order: Sequence[Column], cost: Column, budget: int
) -> DataFrame:
    """Pending rows that start after the budget is used up get the stop reason."""
    spent = running_sum(rows, key, bucket, order, cost, "spent")
    late = (F.col("spent") - cost) >= budget
    return spent.withColumns(
        {
            "stage_status": F.when(late & (F.col("stage_status") == "pending"), STOPPED).otherwise(F.col("stage_status")),
            "reason": F.when(late & (F.col("stage_status") == "pending"), TIME_BUDGET_REASON),
        }
    )
