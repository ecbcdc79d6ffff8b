"""Item marks, totals, score groups, practical ratings and test blueprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions.numbers import percentage, round2
from rankmill.functions.text import trim_ws
from rankmill.operators.contracts import violations

CONFIRMED_TYPES = ("scenario", "journal_entry", "case", "calculation")


def item_mark(
    answer: Column, q_type: Column, points: Column, accepted: Column, rubric_points: Column, override: Column,
) -> Column:
    """Struct (earned, result). ``accepted`` and ``answer`` are in canonical form.
    Open types earn their confirmed rubric points, the rest all or nothing; an
    override replaces the mark; a blank answer stays blank."""
    filled = F.length(trim_ws(F.coalesce(answer, F.lit("")))) > 0
    rubric_sum = F.aggregate(rubric_points, F.lit(0.0), lambda a, p: a + p)
    auto = F.when(F.array_contains(accepted, answer), points).otherwise(F.lit(0.0))
    earned = F.when(filled, F.when(q_type.isin(*CONFIRMED_TYPES), rubric_sum).otherwise(auto)).otherwise(0.0)
    final = F.coalesce(override, earned)
    result = (
        F.when(~filled, "blank").when(final == points, "correct").when(final == 0, "wrong").otherwise("partial")
    )
    return F.struct(final.alias("earned"), result.alias("result"))


def mark_violations(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (key, rule) for marks that must not be accepted.

    ``items``: answer, q_type, points, rubric_maxima and rubric_points (arrays), override, override_reason. A filled answer of
    an open type needs one confirmed score per rubric line, none above its maximum; an override needs a reason and at most the points.
    """
    filled = F.length(trim_ws(F.coalesce("answer", F.lit("")))) > 0
    opened = filled & F.col("q_type").isin(*CONFIRMED_TYPES)
    given, allowed = F.coalesce(F.size("rubric_points"), F.lit(0)), F.coalesce(F.size("rubric_maxima"), F.lit(0))
    above = F.exists(F.arrays_zip("rubric_points", "rubric_maxima"), lambda x: F.coalesce(x["rubric_points"] > x["rubric_maxima"], F.lit(False)))
    stated = F.col("override").isNotNull()
    return violations(
        items, keys,
        {
            "rubric_confirmed": opened & ((given != allowed) | (allowed <= 0)), "rubric_maximum": opened & F.coalesce(above, F.lit(False)),
            "override_reason": stated & (F.length(trim_ws(F.coalesce("override_reason", F.lit("")))) == 0),
            "override_maximum": stated & (F.col("override") > F.col("points")),
        },
    )


def totals(items: DataFrame, attempt: str, pass_mark: float) -> DataFrame:
    """``items``: attempt, earned, possible, result. One combined aggregate."""
    def n_of(result: str) -> Column:
        return F.count_if(F.col("result") == result)

    grouped = items.groupBy(attempt).agg(
        F.sum("earned").alias("raw_score"), F.sum("possible").alias("max_score"),
        n_of("correct").alias("correct_count"), n_of("wrong").alias("wrong_count"),
        n_of("blank").alias("blank_count"), n_of("partial").alias("partial_count"),
        F.min("possible").alias("_lo"), F.max("possible").alias("_hi"),
    )
    needed = F.col("max_score") * pass_mark / 100.0
    return grouped.select(
        attempt, "raw_score", "max_score",
        percentage(F.col("raw_score"), F.col("max_score")).alias("percentage"),
        (F.col("raw_score") * 100 >= F.col("max_score") * pass_mark).alias("passed"),
        "correct_count", "wrong_count", "blank_count", "partial_count",
        F.when(
            F.col("_lo") == F.col("_hi"), F.ceil(needed / F.nullif(F.col("_lo"), F.lit(0.0)))
        ).alias("answers_needed"),
        F.greatest(F.lit(0.0), round2(needed - F.col("raw_score"))).alias("points_needed"),
    )


def score_groups(items: DataFrame, attempt: str, by: Mapping[str, str]) -> DataFrame:
    """Earned, possible and percentage of each attempt by each dimension, in one pass over grouping sets.

    ``by``: dimension name to its column. A member that is null is a member of its own.
    """
    columns = list(by.values())
    grouped = items.groupingSets([[attempt, c] for c in columns], attempt, *columns).agg(
        F.sum("earned").alias("earned"), F.sum("possible").alias("possible"), F.grouping_id().alias("_gid")
    )
    # the bit of a column is 0 where the set holds it
    held = {name: F.col("_gid").bitwiseAND(1 << (len(columns) - 1 - i)) == 0 for i, name in enumerate(by)}
    dimension = F.coalesce(*[F.when(on, F.lit(name)) for name, on in held.items()])
    member = F.coalesce(*[F.when(on, F.col(by[name]).cast("string")) for name, on in held.items()])
    return grouped.select(
        attempt, dimension.alias("dimension"), member.alias("member"), "earned", "possible",
        percentage(F.col("earned"), F.col("possible")).alias("percentage"),
    )


def practical_check(ratings: DataFrame, steps: DataFrame, step: str) -> DataFrame:
    """Violations of rated steps against required ones: missing, over_limit, unknown.
    ``ratings`` is folded to its highest rating per step first."""
    top = ratings.groupBy(step).agg(F.max("points").alias("rated"), F.count(F.lit(1)).alias("n_ratings"))
    required = steps.select(step, F.col("points").alias("allowed"))
    violation = (
        F.when(F.col("allowed").isNull(), "unknown")
        .when(F.col("rated").isNull(), "missing")
        .when(F.col("rated") > F.col("allowed"), "over_limit")
    )
    return top.join(required, step, "full_outer").withColumn("violation", violation)


def allocate(weights: DataFrame, run: Sequence[str], item: str, total: int) -> DataFrame:
    """Largest-remainder split of ``total`` over the weights of each run; ties by
    position. ``weights`` holds one row per (run, item), a short list."""
    share = Window.partitionBy(*run)
    exact = F.lit(total) * F.col("weight") / F.sum("weight").over(share)
    base = weights.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.lit(total) - F.sum("_floor").over(share)
    order = Window.partitionBy(*run).orderBy((F.col("_exact") - F.col("_floor")).desc(), "pos")
    return (
        base.withColumn("_left", left)
        .withColumn("_turn", F.row_number().over(order))
        .select(
            *run, item, "weight", "pos",
            (F.col("_floor") + F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0)).alias("n"),
        )
    )


def positions(allocation: DataFrame, run: Sequence[str], item: str) -> DataFrame:
    """Spread an allocation to one row per position: item 1 n1 times, and so on."""
    before = Window.partitionBy(*run).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        allocation.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where("n > 0")
        .select(*run, item, F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("n") - 1)).alias("i"))
    )


def question_type(i: Column, total: Column, includes_case: Column) -> Column:
    """Type by share of the position: 60% choice, 20% short, the rest open."""
    i, total = i.cast("double"), total.cast("double")
    return (
        F.when(includes_case & (i == total - 1), "case")
        .when((i < F.floor(total * 0.6)) & (i % 8 == 0), "true_false")
        .when(i < F.floor(total * 0.6), "multiple_choice")
        .when(i < F.floor(total * 0.8), "identification")
        .when(i % 3 == 0, "scenario")
        .when(i % 3 == 1, "journal_entry")
        .otherwise("calculation")
    )


def probe_split(lists: Sequence[Column], question_count: int) -> Column:
    """Distinct probes in first-seen order: first fifth kept, the rest uncovered."""
    cap = question_count // 5
    probes = F.array_distinct(F.concat(*lists))
    return F.struct(
        F.slice(probes, 1, cap).alias("kept"),
        F.when(F.size(probes) > cap, F.slice(probes, cap + 1, F.size(probes)))
        .otherwise(F.slice(probes, 1, 0)).alias("uncovered"),
    )
