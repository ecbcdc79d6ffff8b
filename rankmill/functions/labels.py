"""Classes derived from numbers and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmill.functions.text import EDGE_L, EDGE_R, NOT_STATED, stated

# Tier texts, short labels, second-language texts, thresholds.
TIERS = (
    (80.0, "Strong candidate — recommend technical interview", "Strong", "مرشح قوي — يُوصى بمقابلة تقنية"),
    (65.0, "Good — conditional interview", "Good", "جيد — مقابلة مشروطة"),
    (50.0, "Average — reserve list", "Reserve", "متوسط — قائمة احتياط"),
    (None, "Not suitable at this time", "Not suitable", "غير مناسب حالياً"),
)
SENIORITY_LEVELS = (
    "Junior", "Mid-level", "Supervisory", "Supervisory and leadership", "Executive", NOT_STATED,
)
# Title words per class.
JUNIOR_WORDS = r"(?:junior|jr\.?|intern|trainee|graduate|entry[- ]level)"
EXECUTIVE_WORDS = (
    r"(?:chief|ceo|cto|cfo|coo|cio|vice president|vp|director|head of|general manager|executive)"
)
LEADERSHIP_WORDS = (
    r"(?:senior manager|group manager|team lead|tech lead|team leader|lead|principal|staff)"
)
SUPERVISORY_WORDS = r"(?:supervisor|supervisory|manager|superintendent|senior|sr\.?)"
MID_WORDS = r"(?:mid[- ]level|intermediate)"
SALARY_DISCLAIMER = "Indicative estimate, not an offer"
SALARY_MISSING = "Not set — add salary bands"
MISSING_SECOND = "غير مذكور"
STRENGTHS_SECOND = "نقاط القوة"
GAPS_SECOND = "الفجوات والمخاطر"


def _by_tier(score: Column, slot: int) -> Column:
    out = F.when(score >= TIERS[0][0], TIERS[0][slot])
    for tier in TIERS[1:-1]:
        out = out.when(score >= tier[0], tier[slot])
    return out.otherwise(F.lit(TIERS[-1][slot]))


def tier(score: Column) -> Column:
    return F.when(score.isNotNull(), _by_tier(score, 1))


def tier_label(score: Column) -> Column:
    return F.when(score.isNull(), NOT_STATED).otherwise(_by_tier(score, 2))


def tier_second_language(score: Column) -> Column:
    return _by_tier(score, 3)


def narrative_second_language(score: Column, strengths: Column, gaps: Column) -> Column:
    def part(label: str, value: Column) -> Column:
        shown = F.when(F.length(value) > 0, value).otherwise(F.lit(MISSING_SECOND))
        return F.concat(F.lit(f"{label}: "), shown)

    return F.concat_ws(
        " — ", tier_second_language(score), part(STRENGTHS_SECOND, strengths), part(GAPS_SECOND, gaps)
    )


def clean_years(years: Column) -> Column:
    return F.when(~F.isnan(years) & (years >= 0) & (years < float("inf")), years)


def seniority_from_years(years: Column) -> Column:
    return (
        F.when(years < 3, "Junior")
        .when(years < 7, "Mid-level")
        .when(years < 11, "Supervisory")
        .when(years < 16, "Supervisory and leadership")
        .when(years.isNotNull(), "Executive")
    )


def seniority(title: Column, years: Column) -> Column:
    t = stated(title)

    def has(words: str) -> Column:
        return t.rlike(rf"(?iu){EDGE_L}{words}{EDGE_R}")

    return (
        F.when(has(JUNIOR_WORDS) & ~has(EXECUTIVE_WORDS), "Junior")
        .when(has(EXECUTIVE_WORDS), "Executive")
        .when(has(LEADERSHIP_WORDS), "Supervisory and leadership")
        .when(has(SUPERVISORY_WORDS), "Supervisory")
        .when(has(MID_WORDS), "Mid-level")
        .otherwise(F.coalesce(seniority_from_years(clean_years(years)), F.lit(NOT_STATED)))
    )


def title_level(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(t.rlike("director|head|مدير عام|رئيس قسم"), "lead")
        .when(t.rlike("senior|lead|أول|خبير"), "senior")
        .when(t.rlike("junior|assistant|trainee|مبتدئ|مساعد|متدرب"), "junior")
        .otherwise("mid")
    )


def test_level(years: Column, title: Column) -> Column:
    return (
        F.when(title.rlike("(?i)lead|chief|manager|director") | (years >= 10), "lead")
        .when(years >= 6, "senior")
        .when(years >= 3, "mid")
        .otherwise("junior")
    )


def rating_band(mean: Column) -> Column:
    return (
        F.when(mean >= 4.5, "Excellent")
        .when(mean >= 3.5, "Very Good")
        .when(mean >= 2.5, "Good")
        .when(mean >= 1.5, "Average")
        .otherwise("Poor")
    )


def salary_text(low: Column, high: Column) -> Column:
    def whole(c: Column) -> Column:
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))

    return F.when(
        low.isNotNull(),
        F.concat(whole(low), F.lit("–"), whole(high), F.lit(f" AED/month. {SALARY_DISCLAIMER}")),
    ).otherwise(F.lit(f"{SALARY_MISSING}. {SALARY_DISCLAIMER}"))
