"""Data contracts: named rules per row or group, violations as a report table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.text import trim_ws

CLAIM_TAG = r"\A\[(CV|JD|EXAM Q[0-9]+|INTERVIEW #[0-9]+)\]\z"


def violations(df: DataFrame, keys: Sequence[str], broken: Mapping[str, Column]) -> DataFrame:
    """One row per (key, broken rule). A rule that gives null counts as broken."""
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(rule)) for rule, bad in broken.items()])
    )
    return df.select(*keys, F.explode(found).alias("rule"))


def violation_counts(df: DataFrame, keys: Sequence[str], broken: Mapping[str, Column]) -> DataFrame:
    return violations(df, keys, broken).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def outside(c: Column, low: float, high: float) -> Column:
    return ~c.between(low, high)


def not_whole(c: Column) -> Column:
    return c != F.floor(c)


def too_long(c: Column, limit: int) -> Column:
    return F.coalesce(F.length(c) > limit, F.lit(False))


def trimmed_outside(c: Column, low: int, high: int) -> Column:
    return ~F.length(trim_ws(c)).between(low, high)


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def question_rules() -> dict[str, Column]:
    """Columns: q_type, correct, options array, points, rubric_points array, has_calculation."""
    choice = F.col("q_type").isin("multiple_choice", "true_false")
    opened = F.col("q_type").isin("scenario", "journal_entry", "case")
    total = F.aggregate("rubric_points", F.lit(0.0), lambda a, p: a + p)
    return {
        "key_in_options": choice & ~F.array_contains("options", F.col("correct")),
        "options_unique": choice & (F.size(F.array_distinct("options")) != F.size("options")),
        "two_options": choice & (F.size("options") < 2),
        "calculation_present": (F.col("q_type") == "calculation") & ~F.col("has_calculation"),
        "rubric_total": opened
        & ((F.size("rubric_points") == 0) | (F.abs(total - F.col("points")) > 0.001)),
        "points_positive": F.col("points") <= 0,
    }


def interview_rules(ratings: DataFrame, entity: str, n_criteria: int) -> DataFrame:
    """Group rules over (entity, criterion, n_grades)."""
    groups = ratings.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("criterion").alias("n_distinct"),
        F.min("n_grades").alias("lo"), F.max("n_grades").alias("hi"),
    )
    return violations(
        groups, [entity],
        {
            "criteria_complete": F.col("n_distinct") != n_criteria,
            "criteria_unique": F.col("n") != F.col("n_distinct"),
            "same_rater_count": F.col("lo") != F.col("hi"),
            "one_or_two_raters": outside(F.col("lo"), 1, 2) | outside(F.col("hi"), 1, 2),
        },
    )


def claim_rules() -> dict[str, Column]:
    """Columns: kind, claim, evidence array, verification, status."""
    return {
        "kind_known": ~F.col("kind").isin("Evidence", "Inference", "Recommendation"),
        "text_filled": F.length("claim") < 1,
        "evidence_tagged": (F.size("evidence") < 1) | ~F.forall("evidence", lambda e: e.rlike(CLAIM_TAG)),
        "inference_verified": (F.col("kind") == "Inference") & (F.length(trim_ws(F.col("verification"))) == 0),
        "status_known": ~F.col("status").isin("Met", "Partial", "Not met", "Unverified"),
    }


def salary_reference_rules() -> dict[str, Column]:
    """Columns: role_family, pay_min, pay_max, currency, source_url, confidence."""
    return {
        "role_length": outside(F.length("role_family"), 1, 80),
        "min_not_negative": F.col("pay_min") < 0,
        "max_at_least_min": F.col("pay_max") < F.col("pay_min"),
        "currency_code": ~F.col("currency").rlike(r"\A[A-Z]{3}\z"),
        "source_https": ~F.col("source_url").startswith("https://"),
        "confidence_known": ~F.col("confidence").isin("high", "medium", "low"),
    }
