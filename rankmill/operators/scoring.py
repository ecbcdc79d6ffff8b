"""Weighted rubric totals, damping, bands and the long/flat score shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions import labels
from rankmill.functions.text import trim_ws
from rankmill.operators.exports import number_text

# The seven criteria and their default weights.
DEFAULT_WEIGHTS: dict[str, float] = {
    "relevantExperience": 25.0,
    "leadership": 10.0,
    "technicalSkills": 20.0,
    "softwareSystems": 10.0,
    "achievements": 10.0,
    "uaeExperience": 15.0,
    "jobFit": 10.0,
}
FORBIDDEN_SCORING_FIELDS = (
    "fullName", "name", "phone", "email", "linkedin", "nationality", "age",
    "dateOfBirth", "gender", "maritalStatus", "photo",
)
# Columns of a profile that scoring never sees.
HIDDEN_FROM_SCORING = ("fullName", "phone", "email", "linkedin", "nationality", "dataQualityNote")


def criterion_columns(
    scores: DataFrame, entity: Sequence[str], criteria: Mapping[str, str]
) -> DataFrame:
    """Long scores to one row per entity; the last entry of a criterion wins,
    a missing one is null. ``criteria`` maps criterion value to column name.

    One aggregate keyed by entity, combined on the map side, so a busy entity
    sends one row per task.
    """
    latest = [
        F.max_by("score", F.when(F.col("criterion") == key, F.col("pos"))).alias(name)
        for key, name in criteria.items()
    ]
    return scores.groupBy(*entity).agg(*latest)


def weighted_total(
    scores: Sequence[Column], weights: Sequence[Column | float], deal_breaker: Column
) -> Column:
    """0..100 with one decimal; 0 on a deal-breaker or a weight sum of zero."""
    as_cols = [w if isinstance(w, Column) else F.lit(float(w)) for w in weights]
    weight_sum = sum(as_cols[1:], as_cols[0])
    terms = [F.coalesce(s, F.lit(0)) * w for s, w in zip(scores, as_cols)]
    earned = sum(terms[1:], terms[0])
    safe = F.when(weight_sum > 0, weight_sum)
    total = F.floor(earned * 100.0 / safe + 0.5) / 10.0
    return F.when(F.coalesce(deal_breaker, F.lit(False)) | (weight_sum <= 0), 0.0).otherwise(total)


def first_band(value: Column, bands: Column) -> Column:
    """First band in list order whose both-ends-inclusive range holds ``value``."""
    return F.get(
        F.filter(bands, lambda b: (value >= b["low"]) & (value <= b["high"])), F.lit(0)
    )


def salary_for(total: Column, bands: Column) -> Column:
    band = first_band(total, bands)
    return labels.salary_text(band["pay_low"], band["pay_high"])


def allowed_for_scoring(df: DataFrame) -> DataFrame:
    """Drop the columns scoring must not see."""
    hidden = {c.lower() for c in HIDDEN_FROM_SCORING}
    return df.select(*[c for c in df.columns if c.lower() not in hidden])


def forbidden_fields(df: DataFrame) -> list[str]:
    """Names of forbidden fields anywhere in the schema, nested ones included."""
    banned = {c.lower() for c in FORBIDDEN_SCORING_FIELDS}
    found: list[str] = []

    def walk(schema, prefix: str) -> None:
        for field in schema.fields:
            if field.name.lower() in banned:
                found.append(prefix + field.name)
            inner = getattr(field.dataType, "elementType", field.dataType)
            if hasattr(inner, "fields"):
                walk(inner, f"{prefix}{field.name}.")

    walk(df.schema, "")
    return found


def assert_scoring_safe(df: DataFrame) -> DataFrame:
    found = forbidden_fields(df)
    if found:
        raise ValueError(f"columns not allowed in scoring: {', '.join(found)}")
    return df


def dampen(
    scores: Mapping[str, Column],
    relevant_years: Column,
    total_years: Column,
    local_years: Column,
    leadership_text: Column,
    strengths: Column,
    min_years: Column,
) -> dict[str, Column]:
    """Cap scores the profile does not support."""
    years = F.coalesce(relevant_years, total_years, F.lit(0.0))
    silent = F.length(trim_ws(F.coalesce(leadership_text, F.lit("")))) == 0
    short = (years > 0) & (years + 1 < min_years)
    caps = {
        "leadership": ((scores["leadership"] >= 7) & silent & (years < 4), 3),
        "uaeExperience": (
            (scores["uaeExperience"] >= 7) & (F.coalesce(local_years, F.lit(0.0)) <= 0), 2,
        ),
        "achievements": (
            (scores["achievements"] >= 8) & (F.length(trim_ws(strengths)) < 20), 5,
        ),
        "jobFit": (short, 5),
        "relevantExperience": (short, 6),
    }
    out = dict(scores)
    for name, (condition, cap) in caps.items():
        out[name] = F.when(condition, F.least(scores[name], F.lit(cap))).otherwise(scores[name])
    return out


def long_scores(df: DataFrame, keys: Sequence[str], criteria: Sequence[str], evidence: str) -> DataFrame:
    """Flat score columns to (criterion, score, evidence, pos)."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score")) for c in criteria]
    )
    return df.select(*keys, F.posexplode(entries).alias("pos", "entry")).select(
        *keys, "entry.criterion", "entry.score", F.lit(evidence).alias("evidence"), "pos"
    )


def profile_row(flat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The profile of a flat result: facts as stated, years as text, flags as note and list; contact data stay empty.

    ``flat``: location, current_title, last_employer, specialization, education, total_years, relevant_years, local_years,
    leadership_text, software, certifications, languages, flags (lists), strengths, gaps.
    """
    none = F.lit(None).cast("string")

    def years(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(number_text(F.col(c)), F.lit(" years")))

    def one(c: str) -> Column:
        return F.array_compact(F.array(F.when(F.length(F.col(c)) > 0, F.col(c))))

    same = {"currentLocation": "location", "currentTitle": "current_title", "lastEmployer": "last_employer", "specialization": "specialization", "education": "education"}
    empty = ("fullName", "nationality", "availabilityNotice", "expectedSalary", "evidencePages", "phone", "email", "linkedin")
    return flat.select(
        *keys, *[none.alias(n) for n in empty], *[F.col(c).alias(n) for n, c in same.items()],
        years("total_years").alias("totalExperienceText"), F.col("total_years").alias("totalYearsExperience"),
        F.when(F.size("flags") > 0, F.array_join("flags", ", ")).alias("dataQualityNote"),
        years("relevant_years").alias("relevantExperienceText"), F.col("leadership_text").alias("leadershipExperienceText"),
        years("local_years").alias("uaeExperienceText"), F.col("software").alias("softwareSystems"), F.col("software").alias("technicalSkills"),
        "certifications", F.array().cast("array<string>").alias("courses"), "languages", one("strengths").alias("keyAchievements"),
        one("gaps").alias("gaps"), F.col("flags").alias("inconsistencies"),
    )


def finalised(damped: DataFrame, keys: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Total of the damped scores and the narrative in the second language. ``damped``: criteria, deal_breaker, strengths, gaps."""
    total = weighted_total([F.col(c) for c in weights], list(weights.values()), F.col("deal_breaker"))
    scored = damped.withColumn("total_score", total)
    return scored.select(*keys, "total_score", labels.narrative_second_language(F.col("total_score"), F.col("strengths"), F.col("gaps")).alias("narrative"))
