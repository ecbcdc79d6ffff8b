"""View filters as frozen settings that turn into Columns; facets in one pass."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions import labels
from rankmill.functions.text import NOT_STATED, or_not_stated, stated

STATUS_GROUPS = {
    "draft": ("draft",),
    "active": ("queued", "running"),
    "partial": ("partial",),
    "done": ("done",),
    "other": ("cancelled", "failed"),
}


@dataclass(frozen=True)
class ViewFilters:
    """Empty text, None or False means: this filter is off."""

    query: str = ""
    nationality: str = ""
    seniority: str = ""
    language: str = ""
    recommendation: str = ""
    min_score: float | None = None
    hide_deal_breakers: bool = False
    shortlist_only: bool = False

    def is_active(self) -> bool:
        blank = ViewFilters()
        return bool(self.query.strip()) or any(
            getattr(self, f.name) != getattr(blank, f.name) for f in fields(self) if f.name != "query"
        )


INTERVIEW_PRESET = ViewFilters(min_score=65.0, hide_deal_breakers=True)


def with_view_columns(df: DataFrame) -> DataFrame:
    """Cleaned display columns every filter, facet and sort refers to."""
    years = labels.clean_years(F.col("years"))
    return df.withColumns(
        {
            "title_shown": stated(F.col("current_title")),
            "years_shown": years,
            "nationality_shown": or_not_stated(F.col("nationality")),
            "location_shown": or_not_stated(F.col("location")),
            "languages_shown": F.filter(
                F.transform("languages", stated), lambda x: x.isNotNull()
            ),
            "seniority_shown": labels.seniority(F.col("current_title"), F.col("years")),
        }
    )


def search_text(df: DataFrame) -> Column:
    parts = [
        "name", "file_name", "title_shown", "location_shown", "nationality_shown",
        "last_employer", "specialization", "languages", "skills", "strengths",
    ]
    present = [p for p in parts if p in df.columns]
    texts = [
        F.array_join(F.col(p), " ") if df.schema[p].dataType.typeName() == "array" else F.col(p)
        for p in present
    ]
    filled = [F.when(F.length(t) > 0, t) for t in texts]
    return F.lower(F.concat_ws(" ", *filled))


def terms_match(haystack: Column, query: str) -> Column | None:
    """All terms of the query occur in the text."""
    terms = query.lower().split()
    if not terms:
        return None
    return reduce(lambda a, b: a & b, [F.contains(haystack, F.lit(t)) for t in terms])


def filter_columns(df: DataFrame, f: ViewFilters) -> dict[str, Column]:
    """One boolean per active filter, keyed by filter name. ``shortlisted`` must
    be a boolean column when ``shortlist_only`` is set."""
    out: dict[str, Column] = {}
    terms = terms_match(search_text(df), f.query)
    if terms is not None:
        out["query"] = terms
    if f.nationality:
        out["nationality"] = F.lower("nationality_shown") == f.nationality.lower()
    if f.seniority:
        out["seniority"] = F.col("seniority_shown") == f.seniority
    if f.language:
        out["language"] = F.exists("languages_shown", lambda x: F.lower(x) == f.language.lower())
    if f.recommendation:
        out["recommendation"] = F.coalesce(F.col("recommendation") == f.recommendation, F.lit(False))
    if f.min_score is not None:
        out["min_score"] = F.coalesce(F.col("total"), F.lit(-1.0)) >= f.min_score
    if f.hide_deal_breakers:
        out["hide_deal_breakers"] = ~F.coalesce(F.col("deal_breaker"), F.lit(False))
    if f.shortlist_only:
        out["shortlist_only"] = F.col("shortlisted")
    return out


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def apply_filters(df: DataFrame, f: ViewFilters) -> DataFrame:
    return df.where(all_of(list(filter_columns(df, f).values())))


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def facet_counts(df: DataFrame, f: ViewFilters, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per facet value; a facet ignores its own filter only.

    Each row is read once: its values fan out with a flag "passes all other
    filters", and one map-side combined aggregate counts them. The label is the
    spelling of the best-ranked row, or the selected spelling.
    """
    conditions = filter_columns(df, f)

    def others(own: str) -> Column:
        return all_of([c for name, c in conditions.items() if name != own])

    def entries(facet: str, values: Column) -> Column:
        tagged = F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))
        return F.when(others(facet), tagged).otherwise(F.slice(tagged, 1, 0))

    fan = F.concat(
        entries("nationality", F.array("nationality_shown")),
        entries("seniority", F.array("seniority_shown")),
        entries("language", F.col("languages_shown")),
        entries("recommendation", F.array_compact(F.array("recommendation"))),
    )
    chosen = {
        "nationality": f.nationality, "seniority": f.seniority,
        "language": f.language, "recommendation": f.recommendation,
    }
    label = F.col("first_spelling")
    for facet, value in chosen.items():
        if value:
            label = F.when(
                (F.col("facet") == facet) & (F.col("value_key") == value.lower()), value
            ).otherwise(label)
    # first per exact spelling, with numbers only in the buffers; then the few spellings of a value
    spelled = (
        df.select(*by, _place().alias("place"), F.explode(fan).alias("e"))
        .groupBy(*by, F.col("e.facet").alias("facet"), F.col("e.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    )
    return (
        spelled.groupBy(*by, "facet", F.lower("value").alias("value_key"))
        .agg(F.sum("n").alias("n"), F.array_min(F.collect_list(F.struct("place", "value")))["value"].alias("first_spelling"))
        .select(*by, "facet", label.alias("value"), "n")
    )


def _place() -> Column:
    """Rank order as one number: totals of one decimal falling (null as -1), then ids ascending."""
    behind = F.floor((1000 - F.coalesce("total", F.lit(-1.0))) * 10 + 0.5).cast("decimal(18,0)")
    return (behind * F.lit(str(10**19)).cast("decimal(20,0)") + F.col("id").cast("decimal(19,0)")).cast("decimal(38,0)")


def facet_useful(facets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return facets.groupBy(*by, "facet").agg(F.max(F.col("value") != NOT_STATED).alias("useful"))


def facet_sort_key(facet: Column, value: Column, n: Column, by_count: bool = False) -> list[Column]:
    """Sort keys: fixed class order for classes, else (count), name, missing last."""
    level = F.lit(99)
    for i, name in reversed(list(enumerate(labels.SENIORITY_LEVELS))):
        level = F.when((facet == "seniority") & (value == name), i).otherwise(level)
    for i, entry in reversed(list(enumerate(labels.TIERS))):
        level = F.when((facet == "recommendation") & (value == entry[1]), i).otherwise(level)
    classed = facet.isin("seniority", "recommendation")
    keys = [F.when(classed, level).otherwise(0), F.when(~classed, (value == NOT_STATED).cast("int"))]
    if by_count:
        keys.append(F.when(~classed, -n))
    return [*keys, F.lower(value)]


def status_in_group(status: Column, group: str) -> Column:
    return F.lit(True) if group == "all" else status.isin(*STATUS_GROUPS[group])
