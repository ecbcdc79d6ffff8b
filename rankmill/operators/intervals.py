"""Date ranges: text to ranges, gaps, overlaps, anomalies, covered time.

Months are integers (year*12 + month-1) and ends are exclusive. All per-entity
work runs on ranges folded to months, so an entity with very many ranges is
reduced on the map side to at most one row per distinct month (or month pair).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions.arrays import bind
from rankmill.functions.text import WS, ascii_digits

# Month names and the date forms that may stand in a range.
MONTHS = (
    "jan|january|يناير", "feb|february|فبراير", "mar|march|مارس", "apr|april|ابريل|أبريل",
    "may|مايو", "jun|june|يونيو", "jul|july|يوليو", "aug|august|اغسطس|أغسطس",
    "sep|sept|september|سبتمبر", "oct|october|اكتوبر|أكتوبر", "nov|november|نوفمبر",
    "dec|december|ديسمبر",
)
DATE_FORMS = (
    rf"(?:{'|'.join(MONTHS)}){WS}+[0-9]{{4}}|[0-9]{{4}}[-/][0-9]{{1,2}}|[0-9]{{1,2}}/[0-9]{{4}}"
    r"|[0-9]{4}|present|current|الآن|الحالي|حتى الآن"
)
RANGE_FORM = rf"(?i)({DATE_FORMS}){WS}*(?:[-–—]|to|حتى|إلى){WS}*({DATE_FORMS})"
MAX_MONTHS = 600


def month_index(value: Column, as_of_month: int, ending: bool) -> Column:
    """Struct (m, precise) of one date text; m is null when it is no valid month."""
    extra = 1 if ending else 0
    open_ended = value.rlike("(?i)present|current|الآن|الحالي")

    def read(numbers: Column) -> Column:
        n0 = F.get(numbers, F.lit(0)).try_cast("int")
        n1 = F.get(numbers, F.lit(1)).try_cast("int")
        two = F.size(numbers) == 2
        named = F.lit(12 if ending else 1)
        for i, names in reversed(list(enumerate(MONTHS))):
            named = F.when(value.rlike(rf"(?i)\A(?:{names}){WS}"), i + 1).otherwise(named)
        year = F.when(two & (n0 <= 1900), n1).otherwise(n0)
        month = F.when(two & (n0 > 1900), n1).when(two, n0).otherwise(named)
        index = year * 12 + month - 1 + extra
        return F.struct(
            F.when(open_ended, F.lit(as_of_month + extra))
            .when(year.between(1900, 2200) & month.between(1, 12), index).alias("m"),
            (open_ended | two | value.rlike(r"(?i)[a-z\x{0600}-\x{06FF}]")).alias("precise"),
        )

    return bind(F.regexp_extract_all(value, F.lit("([0-9]+)"), F.lit(1)), read)


def ranges_in_text(text: Column, as_of_month: int) -> Column:
    """Array of (start_m, end_m, label, evidence, precise) found in a text."""
    # a page chunk starts at the line that holds a page marker
    chunks = F.split(ascii_digits(text), r"(?m)^(?=[^\n]*\[\[PAGE [0-9]+\]\])", -1)

    def from_line(line: Column, evidence: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(RANGE_FORM), F.lit(0))

        def one(hit: Column) -> Column:
            ends = F.array(
                bind(F.regexp_extract(hit, RANGE_FORM, 1), lambda v: month_index(v, as_of_month, False)),
                bind(F.regexp_extract(hit, RANGE_FORM, 2), lambda v: month_index(v, as_of_month, True)),
            )
            return bind(
                ends,
                lambda e: F.struct(
                    e[0]["m"].alias("start_m"), e[1]["m"].alias("end_m"),
                    F.substring(line, 1, 240).alias("label"), evidence.alias("evidence"),
                    (e[0]["precise"] & e[1]["precise"]).alias("precise"),
                ),
            )

        # a date holds four digits or an open-end word; other lines are skipped
        dated = line.rlike("(?i)[0-9]{4}|present|current|الآن|الحالي")
        return F.when(dated, F.transform(found, one))

    def from_chunk(chunk: Column) -> Column:
        page = F.regexp_extract(chunk, r"\[\[PAGE ([0-9]+)\]\]", 1)
        evidence = F.when(page != "", F.concat(F.lit("[CV p."), page, F.lit("]"))).otherwise("[CV]")
        per_line = F.transform(F.split(chunk, "\r?\n"), lambda ln: from_line(ln, evidence))
        return F.flatten(F.array_compact(per_line))

    found = F.flatten(F.transform(chunks, from_chunk))
    return F.filter(found, lambda r: r["start_m"].isNotNull() & r["end_m"].isNotNull())


def anomaly(start: Column, end: Column, now_m: int) -> Column:
    """Struct (code, months); null for a range without anomaly."""
    def tag(code: str, months: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), months.alias("months"))

    return (
        F.when(start >= end, tag("impossible_tenure", start - end))
        .when((end > now_m) | (start >= now_m), tag("future_date", end - now_m))
        .when(end - start > MAX_MONTHS, tag("impossible_tenure", end - start))
    )


def sane(ranges: DataFrame, now_m: int) -> DataFrame:
    return ranges.where((F.col("start_m") < F.col("end_m")) & (F.col("end_m") <= now_m))


def _by_start_month(ranges: DataFrame) -> DataFrame:
    """One row per (entity, start month): the first range of the month, and the
    furthest one with the order key that decides ties."""
    who = F.struct("precise", "evidence")
    return ranges.groupBy("entity", "start_m").agg(
        F.min_by(who, F.struct("end_m", "pos")).alias("head"),
        F.max(
            F.struct(
                F.col("end_m").alias("end_m"), (-F.col("start_m")).alias("s"),
                (-F.col("pos")).alias("p"), F.col("precise").alias("precise"),
                F.col("evidence").alias("evidence"),
            )
        ).alias("far"),
    )


def _with_furthest(ranges: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("start_m").rowsBetween(Window.unboundedPreceding, -1)
    return _by_start_month(ranges).withColumn("before", F.max("far").over(w))


def gaps(ranges: DataFrame, now_m: int, min_months: int = 3) -> DataFrame:
    """Distance from the furthest end so far, both sides precise."""
    months = F.col("start_m") - F.col("before.end_m")
    return (
        _with_furthest(sane(ranges, now_m))
        .where((months >= min_months) & F.col("head.precise") & F.col("before.precise"))
        .select(
            "entity", "start_m", months.alias("months"),
            F.col("before.evidence").alias("evidence_before"),
            F.col("head.evidence").alias("evidence_after"),
        )
    )


def covered_years(ranges: DataFrame, now_m: int) -> DataFrame:
    """Years covered by the union of ranges, two decimals."""
    new = F.greatest(
        F.lit(0),
        F.col("far.end_m") - F.greatest(F.col("start_m"), F.coalesce(F.col("before.end_m"), F.lit(0))),
    )
    return (
        _with_furthest(sane(ranges, now_m))
        .groupBy("entity")
        .agg(F.sum(new).alias("months"))
        .select("entity", "months", (F.floor(F.col("months") / 12.0 * 100 + 0.5) / 100).alias("years"))
    )


def overlap_pairs(ranges: DataFrame, now_m: int, cell_months: int = 12) -> DataFrame:
    """Every overlap of two precise ranges of one entity, with position and evidence of both sides, the earlier position first.

    A sweep cut into calendar cells: a range stands in each cell it touches, and two ranges meet in the cell of
    their later start, where the one that starts first is still open. Work per (entity, cell) follows what is open there; the
    output is in step with the number of overlaps. A busy entity is spread over its cells, a busy cell by the skew join.
    """
    here = sane(ranges, now_m).where("precise").select("entity", "pos", "start_m", "end_m", "evidence")
    celled = here.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("start_m") / cell_months), F.floor((F.col("end_m") - 1) / cell_months)))
    )
    # the side that starts later (ties: the later position) stands only in the cell of its start
    later = here.withColumn("cell", F.floor(F.col("start_m") / cell_months))
    a, b = celled.alias("a"), later.alias("b")
    before = F.struct("a.start_m", "a.pos") < F.struct("b.start_m", "b.pos")
    first = F.col("a.pos") < F.col("b.pos")

    def side(c: str, lower: bool) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        return F.when(first, x).otherwise(y) if lower else F.when(first, y).otherwise(x)

    return a.join(
        b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.cell") == F.col("b.cell")) & before & (F.col("a.end_m") > F.col("b.start_m"))
    ).select(
        F.col("a.entity").alias("entity"), side("pos", True).alias("a_pos"), side("pos", False).alias("b_pos"),
        (F.least("a.end_m", "b.end_m") - F.col("b.start_m")).alias("months"),
        side("evidence", True).alias("evidence_a"), side("evidence", False).alias("evidence_b"),
    )


def overlaps(ranges: DataFrame, now_m: int, cell_months: int = 12) -> DataFrame:
    """Overlapping precise ranges of one entity, folded to distinct month pairs.

    Equal (start, end) ranges become one row with a count; ``n_pairs`` says how
    many range pairs a row stands for, so the result is whole while its size
    follows the month grid, not the square of the rows. The self join is keyed
    by entity and calendar cell, which splits a busy entity over many tasks; a
    pair is kept in the cell of its later start only.
    """
    folded = (
        sane(ranges, now_m).where("precise")
        .groupBy("entity", "start_m", "end_m")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cell = F.sequence(
        F.floor(F.col("start_m") / cell_months), F.floor((F.col("end_m") - 1) / cell_months)
    )
    celled = folded.withColumn("cell", F.explode(cell))
    a, b = celled.alias("a"), celled.alias("b")
    later = F.greatest("a.start_m", "b.start_m")
    months = F.least("a.end_m", "b.end_m") - later
    same = (F.col("a.start_m") == F.col("b.start_m")) & (F.col("a.end_m") == F.col("b.end_m"))
    ordered = F.struct("a.start_m", "a.end_m") <= F.struct("b.start_m", "b.end_m")
    pairs = F.when(same, F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n"))
    return (
        a.join(
            b,
            (F.col("a.entity") == F.col("b.entity")) & (F.col("a.cell") == F.col("b.cell"))
            & ordered & (months > 0) & (F.floor(later / cell_months) == F.col("a.cell")),
        )
        .select(
            F.col("a.entity").alias("entity"),
            F.col("a.start_m").alias("a_start"), F.col("a.end_m").alias("a_end"),
            F.col("b.start_m").alias("b_start"), F.col("b.end_m").alias("b_end"),
            months.alias("months"), pairs.cast("long").alias("n_pairs"),
        )
        .where("n_pairs > 0")
    )


