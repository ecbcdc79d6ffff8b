"""First-pass relevance of documents to their job text, and top-k agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.arrays import bind, run_lengths
from rankmill.functions.numbers import half_up
from rankmill.functions.text import keyword_ratio, tokens, years_stated

# Places every location check looks for, and the part weights.
FIXED_PLACES = ("uae", "abu dhabi", "dubai", "الإمارات", "أبوظبي")
PART_WEIGHTS = {"cosine": 40.0, "must": 30.0, "nice": 10.0, "years": 10.0, "location": 10.0}


def term_counts(text: Column) -> Column:
    """(x, n) per distinct token. One text is one row, so nothing is shuffled."""
    return run_lengths(tokens(text))


def term_frequencies(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    return docs.select(row_id, F.explode(term_counts(F.col(text))).alias("t")).select(
        row_id, F.col("t.x").alias("token"), F.col("t.n").alias("n")
    )


def _squares(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, t: a + t["n"].cast("long") * t["n"])


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two term-count arrays; 0 when either is empty. ``left`` should
    be the shorter one: it is probed into a map of ``right``."""
    def score(terms: Column) -> Column:
        def dot(lookup: Column) -> Column:
            return F.aggregate(
                left, F.lit(0).cast("long"),
                lambda a, t: a
                + t["n"].cast("long") * F.coalesce(F.try_element_at(lookup, t["x"]), F.lit(0)),
            )

        norm = F.sqrt(_squares(left).cast("double")) * F.sqrt(_squares(terms).cast("double"))
        return F.when((F.size(left) == 0) | (F.size(terms) == 0), F.lit(0.0)).otherwise(
            bind(F.map_from_entries(terms), dot) / F.nullif(norm, F.lit(0.0))
        )

    return bind(right, score)


def job_terms(description: Column, must: Column, nice: Column, education: Column, location: Column) -> Column:
    """Term counts of everything a job says; computed once per job."""
    blank = F.lit("")
    return term_counts(
        F.concat_ws(
            " ", description, F.array_join(must, " "), F.array_join(nice, " "),
            F.coalesce(education, blank), F.coalesce(location, blank),
        )
    )


def places(location: Column, scope: Column) -> Column:
    own = F.filter(F.array(location, scope), lambda x: F.coalesce(F.length(x), F.lit(0)) > 0)
    return F.concat(own, F.array(*[F.lit(p) for p in FIXED_PLACES]))


def years_part(years: Column, minimum: Column) -> Column:
    return (
        F.when(years.isNull(), F.lit(0.5))
        .when(minimum.isNotNull(), F.least(F.lit(1.0), years / F.greatest(minimum, F.lit(1.0))))
        .otherwise(F.least(F.lit(1.0), years / 10.0))
    )


def relevance_parts(docs: DataFrame, jobs: DataFrame, job: str) -> DataFrame:
    """Parts of the score per document and its own job.

    ``docs``: job key, text. ``jobs``: job key, terms (see ``job_terms``), must,
    nice, min_years, location, scope. Jobs are joined by key: Spark broadcasts
    them when their measured size allows and splits a hot job otherwise.
    """
    # one lower-case copy serves the three keyword checks
    joined = docs.join(jobs, job).withColumn("_lower", F.lower("text"))
    lower = F.col("_lower")
    return joined.select(
        *docs.columns,
        cosine(F.col("terms"), term_counts(F.col("text"))).alias("cosine"),
        keyword_ratio(lower, F.col("must")).alias("must_ratio"),
        keyword_ratio(lower, F.col("nice")).alias("nice_ratio"),
        keyword_ratio(lower, places(F.col("location"), F.col("scope"))).alias("location_ratio"),
        years_part(years_stated(F.col("text")), F.col("min_years")).alias("years_ratio"),
    )


def relevance_score(cosine_: Column, must: Column, nice: Column, years: Column, location: Column) -> Column:
    w = PART_WEIGHTS
    total = (
        cosine_ * w["cosine"] + must * w["must"] + nice * w["nice"]
        + years * w["years"] + location * w["location"]
    )
    return half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 1)


def relevance(docs: DataFrame, jobs: DataFrame, job: str) -> DataFrame:
    parts = relevance_parts(docs, jobs, job)
    score = relevance_score(
        F.col("cosine"), F.col("must_ratio"), F.col("nice_ratio"),
        F.col("years_ratio"), F.col("location_ratio"),
    )
    return parts.select(*[c for c in docs.columns if c != "text"], score.alias("relevance"))


def overlap_at_k(top: DataFrame, expected: DataFrame, group: str, row_id: str, k: int) -> DataFrame:
    """How many of each group's top k are on the expected list."""
    hit = expected.select(row_id).distinct().withColumn("hit", F.lit(1))
    return (
        top.join(hit, row_id, "left")
        .groupBy(group)
        .agg(F.count("hit").alias("overlap"), F.count(F.lit(1)).alias("shown"))
        .withColumn("k", F.lit(k))
    )
