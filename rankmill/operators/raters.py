"""Interview ratings: means, clusters, histogram, agreement of two raters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.labels import rating_band
from rankmill.functions.numbers import percentage, round2

# Points per grade.
GRADE_POINTS = {"A": 5, "B": 4, "C": 3, "D": 2, "E": 1}


def grade_points(grade: Column) -> Column:
    out = F.when(grade == "A", 5)
    for g, p in list(GRADE_POINTS.items())[1:]:
        out = out.when(grade == g, p)
    return out


def criterion_mean(g1: Column, g2: Column) -> Column:
    """Mean points of one criterion over one or two raters."""
    p1, p2 = grade_points(g1), grade_points(g2)
    return F.when(p2.isNull(), p1.cast("double")).otherwise((p1 + p2) / 2.0)


def interview_totals(
    ratings: DataFrame, entity: str, n_criteria: int, excluded: Sequence[int]
) -> DataFrame:
    """``ratings``: entity, criterion, grade1, grade2 (null when one rater)."""
    mean = criterion_mean(F.col("grade1"), F.col("grade2"))
    counted = F.when(~F.col("criterion").isin(*excluded), mean) if excluded else mean
    out = ratings.groupBy(entity).agg(
        F.sum(grade_points(F.col("grade1"))).alias("total1"),
        F.sum(grade_points(F.col("grade2"))).alias("total2"),
        F.avg(mean).alias("_raw"),
        F.coalesce(F.avg(counted), F.lit(0.0)).alias("_overall"),
    )
    return out.select(
        entity, "total1", "total2",
        round2(F.col("total1") / float(n_criteria)).alias("average1"),
        round2(F.col("total2") / float(n_criteria)).alias("average2"),
        round2(F.col("_raw")).alias("raw_average"),
        round2(F.col("_overall")).alias("overall_average"),
        percentage(F.col("_raw"), F.lit(5.0)).alias("raw_percentage"),
        percentage(F.col("_overall"), F.lit(5.0)).alias("percentage"),
        rating_band(F.col("_overall")).alias("band"),
    )


def cluster_means(
    ratings: DataFrame, entity: str, clusters: Mapping[str, Sequence[int]], excluded: Sequence[int]
) -> DataFrame:
    """Mean per fixed set of criteria; null when every member is excluded."""
    mean = criterion_mean(F.col("grade1"), F.col("grade2"))
    cols = [
        round2(
            F.avg(F.when(F.col("criterion").isin([i for i in ids if i not in excluded]), mean))
        ).alias(name)
        for name, ids in clusters.items()
    ]
    return ratings.groupBy(entity).agg(*cols)


def grade_histogram(ratings: DataFrame) -> DataFrame:
    return (
        ratings.select(F.explode(F.array_compact(F.array("grade1", "grade2"))).alias("grade"))
        .groupBy("grade")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def agreement(ratings: DataFrame, entity: str) -> DataFrame:
    """Means, population variances, disagreements, leniency and halo flags."""
    a, b = grade_points(F.col("grade1")), grade_points(F.col("grade2"))
    delta = F.abs(a - b)
    # population variance from whole-number sums: exact, order does not matter
    n = F.count(F.lit(1))
    def variance(p: Column) -> Column:
        return (n * F.sum(p * p) - F.sum(p) * F.sum(p)) / (n * n)
    both = ratings.where(F.col("grade1").isNotNull() & F.col("grade2").isNotNull())
    out = both.groupBy(entity).agg(
        n.alias("n"), (F.sum(a) / n).alias("mean1"), (F.sum(b) / n).alias("mean2"),
        variance(a).alias("var1"), variance(b).alias("var2"),
        F.sum(delta).alias("delta_sum"), F.count_if(delta >= 2).alias("disagreements"),
    )
    return out.withColumns(
        {
            "leniency": F.when(
                F.abs(F.col("mean1") - F.col("mean2")) >= 1,
                "relative leniency/severity; not proof of bias",
            ).otherwise("none"),
            "halo1": (F.col("n") >= 4) & (F.col("var1") < 0.1),
            "halo2": (F.col("n") >= 4) & (F.col("var2") < 0.1),
            "insufficient": F.col("n") < 4,
        }
    )


def disagreements(ratings: DataFrame, entity: str) -> DataFrame:
    delta = F.abs(grade_points(F.col("grade1")) - grade_points(F.col("grade2")))
    return ratings.where(delta >= 2).select(entity, "criterion", delta.alias("delta"))
