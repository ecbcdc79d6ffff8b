"""Row changes as set-based plans: status moves, upserts, audit, clone, reset, delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.operators.ranking import previous_value
from rankmill.operators.tracking import CAP_REASON, STOPPED

# Allowed moves of a run and of a change proposal.
ALLOWED_MOVES = (
    ("draft", "queued"), ("queued", "running"), ("queued", "cancelled"),
    ("running", "cancelled"), ("running", "done"),
    ("pending", "approved"), ("pending", "rejected"),
)


def status_moves(requests: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Each request against the stored state: accepted, or the reason why not.
    The allowed pairs are a fixed list, so they become one expression."""
    allowed = F.struct(F.col("status"), F.col("wanted")).isin(
        *[F.struct(F.lit(a), F.lit(b)) for a, b in ALLOWED_MOVES]
    )
    verdict = (
        F.when(F.col("status").isNull(), "not_found").when(allowed, "accepted").otherwise("not_allowed")
    )
    return requests.join(state, key, "left").withColumn("verdict", verdict)


def upsert_latest(
    state: DataFrame, changes: DataFrame, key: str, order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """State after the changes: the latest change of a key wins, new keys appear.
    Changes fold to one row per key on the map side before they meet the state."""
    latest = changes.groupBy(key).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_new"),
        F.count(F.lit(1)).alias("n_changes"),
    )
    merged = state.join(latest, key, "full_outer")
    return merged.select(
        key,
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{v}")).otherwise(F.col(v)).alias(v)
            if v in state.columns else F.col(f"_new.{v}").alias(v)
            for v in values
        ],
        F.coalesce("n_changes", F.lit(0)).alias("n_changes"),
    )


def audit_rows(
    changes: DataFrame, key: str, bucket: str, order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Before and after of every change as JSON; before is null for the first."""
    after = F.to_json(F.struct(*values))
    with_prev = previous_value(changes, [key], bucket, order, after, "before_json")
    return with_prev.withColumn("after_json", after)


def append_audit(audit: DataFrame, path: str) -> None:
    """Append to the audit table, one folder per entity type."""
    audit.write.mode("append").partitionBy("entity_type").parquet(path)


def clone_rows(rows: DataFrame, new_job: str) -> DataFrame:
    """Copies for another job: parsed text kept, every score cleared. Relevance is
    cleared too, since it belongs to the old job text; unscored rows are eligible."""
    parsed = F.col("parse_status") == "parsed"
    stage = F.when(parsed & F.col("has_profile"), "extracted").otherwise("pending")
    return rows.withColumns(
        {
            "job": F.lit(new_job), "total": F.lit(None).cast("double"),
            "relevance": F.lit(None).cast("double"), "stage_status": stage,
            "error": F.when(~parsed, F.col("error")),
        }
    )


def reset_resumable(rows: DataFrame, job: str) -> DataFrame:
    """Stopped rows go back to pending, except those outside the cap; jobs without
    any such row are refused (``accepted`` false, rows unchanged)."""
    hit = (F.col("stage_status") == STOPPED) & (
        F.coalesce(F.col("error"), F.lit("")) != CAP_REASON
    )
    open_jobs = rows.where(hit).select(job).distinct().withColumn("_open", F.lit(True))
    return (
        rows.join(open_jobs, job, "left")
        .withColumn("accepted", F.coalesce("_open", F.lit(False)))
        .withColumn("error", F.when(hit, F.lit(None)).otherwise(F.col("error")))
        .withColumn("stage_status", F.when(hit, "pending").otherwise(F.col("stage_status")))
        .drop("_open")
    )


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


MAX_DELETE = 50


def delete_guard(requested: DataFrame, jobs: DataFrame, key: str, active: Sequence[str]) -> DataFrame:
    """One row: the ids to delete, and why the whole delete is refused or null. 1 to
    50 distinct ids, all known, none active. One id more than allowed is enough to
    refuse, so at most 51 rows are looked at."""
    found = requested.select(key).limit(MAX_DELETE + 1).join(jobs.select(key, "status"), key, "left")
    stats = found.agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(key).alias("ids"),
        F.count_if(F.col("status").isNull()).alias("missing"),
        F.count_if(F.col("status").isin(*active)).alias("busy"),
    )
    n = F.col("n")
    reason = (
        F.when(~n.between(1, MAX_DELETE) | (n != F.size("ids")), "INVALID_INPUT")
        .when(F.col("missing") > 0, "JOB_NOT_FOUND")
        .when(F.col("busy") > 0, "DELETE_ACTIVE_JOBS")
    )
    return stats.select("ids", reason.alias("refused"))


def delete_all_or_nothing(
    requested: DataFrame, jobs: DataFrame, children: DataFrame, key: str, active: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Jobs and child rows that remain. A refused request removes nothing."""
    verdict = delete_guard(requested, jobs, key, active)
    doomed = verdict.where("refused is null").select(F.explode("ids").alias(key))
    return jobs.join(doomed, key, "left_anti"), children.join(doomed, key, "left_anti")
