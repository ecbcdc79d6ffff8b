"""Request table for a scoring model. No model is called: the job prepares,
checks and quarantines the batch."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.text import has_raw_pii, scrub, shorten_by_section

FLAG_LINE = "Include flags when date issues are explicit."
NO_FLAG_LINE = "Do not include flags; return flags as []."


def rubric_block(
    must: Column, nice: Column, min_years: Column, education: Column, location: Column,
    deal_breakers: Column, weights: Sequence[tuple[str, Column]],
) -> Column:
    """Compact rubric text; one per job."""
    def listed(items: Column, cap: int) -> Column:
        joined = F.array_join(F.slice(items, 1, cap), "; ")
        return F.when(F.length(joined) > 0, joined).otherwise("none")

    none = F.lit("n")
    weight_text = F.concat_ws(",", *[F.concat(F.lit(f"{k}:"), w.cast("string")) for k, w in weights])
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Must:"), listed(must, 6)),
        F.concat(F.lit("Nice:"), listed(nice, 4)),
        F.concat(F.lit("MinYears:"), F.coalesce(min_years.cast("string"), none)),
        F.concat(F.lit("Edu:"), F.coalesce(education, none)),
        F.concat(F.lit("Loc:"), F.coalesce(location, none)),
        F.concat(F.lit("DB:"), listed(deal_breakers, 3)),
        F.concat(F.lit("W:"), weight_text),
    )


def user_text(text: Column, flags: Column | None = None) -> Column:
    """``flags``: whether the answer is to hold flags; null counts as no. Without the argument it does."""
    line = F.lit(FLAG_LINE) if flags is None else F.when(flags, FLAG_LINE).otherwise(NO_FLAG_LINE)
    return F.concat(F.lit("CV text:\n"), text, F.lit("\n\n"), line)


def filled(template: str, values: Mapping[str, Column], missing: str = "none") -> Column:
    """A template with its ``{name}`` slots filled; null and empty values read ``missing``. An unknown slot is refused."""
    pieces = re.split(r"\{(\w+)\}", template)
    if unknown := sorted(set(pieces[1::2]) - set(values)):
        raise ValueError(f"template slots without a value: {unknown}")
    shown = [F.coalesce(F.nullif(values[x].cast("string"), F.lit("")), F.lit(missing)) if i % 2 else F.lit(x) for i, x in enumerate(pieces)]
    return F.concat(*shown)


def request_texts(
    rows: DataFrame, keys: Sequence[str], kind: str, templates: Mapping[str, tuple[str, str]], values: Mapping[str, Column],
    language: Column, rules: Mapping[str, str], default: str,
) -> DataFrame:
    """``keys, kind, system_text, user_text`` by the pair of templates of each row's kind; a row of another kind has none.

    The language rule ends the system text: that of ``language``, or of ``default`` where it is null or unknown.
    """
    def chosen(options: Mapping[str, Column], by: Column, otherwise: Column) -> Column:
        return reduce(lambda rest, x: F.when(by == x[0], x[1]).otherwise(rest), options.items(), otherwise)

    rule = chosen({k: F.lit(v) for k, v in rules.items()}, language, F.lit(rules[default]))
    none = F.lit(None).cast("string")
    systems = {k: F.concat(filled(a, values), F.lit("\n"), rule) for k, (a, _) in templates.items()}
    users = {k: filled(b, values) for k, (_, b) in templates.items()}
    return rows.select(*keys, kind, chosen(systems, F.col(kind), none).alias("system_text"), chosen(users, F.col(kind), none).alias("user_text"))


def request_table(
    docs: DataFrame, jobs: DataFrame, job: str, row_id: str, limit: int = 2000, flags: Column | None = None
) -> DataFrame:
    """One system/user pair per document; rows with personal data left are marked
    ``quarantine`` and carry no text. ``jobs`` has job and system_text; ``flags`` is a column of it."""
    short = docs.select(row_id, job, shorten_by_section(scrub(F.col("text")), limit).alias("_t"))
    return short.join(jobs.select(job, "system_text", (F.lit(True) if flags is None else flags).alias("_flags")), job).select(
        row_id, job,
        F.when(has_raw_pii(F.col("_t")), "quarantine").otherwise("ready").alias("state"),
        "system_text",
        F.when(~has_raw_pii(F.col("_t")), user_text(F.col("_t"), None if flags is None else F.col("_flags"))).alias("user_text"),
    )


# Questions in the second output language.
FLAG_QUESTIONS = {
    "date_gap": "وضّح الفجوة الزمنية بين الوظائف وأرفق خطابات الخبرة",
    "overlap": "وضّح تداخل فترات العمل بين جهتين إن وُجد، مع إثبات التواريخ",
    "summary_mismatch": "طابق ملخص السيرة مع الخبرات الفعلية وأعط مثالاً قابلاً للتحقق",
    "future_date": "صحّح أي تاريخ مستقبلي في السيرة وأرفق ما يثبت الفترة الفعلية",
    "missing_dates": "أكمل تواريخ البدء والانتهاء لكل وظيفة مع الشهر والسنة",
}
ASK_CERTIFICATES = "أرفق الشهادات المهنية وأرقامها وتواريخها للتحقق"
ASK_NOTICE = "حدّد فترة الإشعار وتاريخ المباشرة المتوقع"
ASK_LOCAL = "وضّح سنوات الخبرة داخل الإمارات وجهة العمل الأخيرة هناك"
QUESTION_CAP = 8


def distinct_questions(questions: Column) -> Column:
    return F.slice(F.array_distinct(questions), 1, QUESTION_CAP)


def verification_questions(flags: Column, certifications: Column, local_years: Column) -> Column:
    """Questions for the first three flags and for missing facts."""
    lookup = F.create_map(*[F.lit(x) for pair in FLAG_QUESTIONS.items() for x in pair])
    from_flags = F.transform(F.slice(flags, 1, 3), lambda f: F.try_element_at(lookup, f))
    facts = F.array(
        F.when(F.coalesce(F.size(certifications), F.lit(0)) <= 0, ASK_CERTIFICATES),
        F.lit(ASK_NOTICE),
        F.when(F.coalesce(local_years, F.lit(0.0)) == 0, ASK_LOCAL),
    )
    return distinct_questions(F.concat(from_flags, F.array_compact(facts)))
