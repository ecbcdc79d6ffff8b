"""Composite score, gates, conditions and outcome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmill.functions.numbers import round2

# Weights of (document, test, interview) per level.
LEVEL_WEIGHTS = {
    "junior": (25, 40, 35), "mid": (25, 35, 40), "senior": (20, 30, 50), "lead": (20, 25, 55),
}


def composite(level: Column, cv: Column, exam: Column, interview: Column) -> Column:
    def one(w: tuple[int, int, int]) -> Column:
        return round2((cv * w[0] + exam * w[1] + interview * w[2]) / float(sum(w)))

    out = None
    for name, w in LEVEL_WEIGHTS.items():
        out = F.when(level == name, one(w)) if out is None else out.when(level == name, one(w))
    return out


def valid_inputs(*scores: Column) -> Column:
    ok = F.lit(True)
    for s in scores:
        ok = ok & F.coalesce(s.between(0, 100) & ~F.isnan(s), F.lit(False))
    return ok


def gates(exam: Column, pass_mark: Column, coverage: Column, deal_breaker: Column) -> Column:
    """Array of (rule, condition). ``coverage``: array of (requirement, status, verification)."""
    def entry(rule: Column, condition: Column) -> Column:
        return F.struct(rule.alias("rule"), condition.alias("condition"))

    shown = F.when(pass_mark == F.floor(pass_mark), F.floor(pass_mark).cast("string")).otherwise(
        pass_mark.cast("string")
    )
    exam_gate = F.when(
        exam < pass_mark,
        entry(
            F.concat(F.lit("Exam below pass mark ("), shown, F.lit("%)")),
            F.concat(F.lit("Retake exam and achieve at least "), shown, F.lit("% before independent duties")),
        ),
    )
    open_items = F.transform(
        F.filter(coverage, lambda c: c["status"] != "Met"),
        lambda c: entry(
            F.concat(F.lit("Must-have "), c["status"], F.lit(": "), c["requirement"]),
            F.when(F.length(c["verification"]) > 0, c["verification"]).otherwise(
                F.concat(F.lit("Verify and demonstrate "), c["requirement"], F.lit(" before offer"))
            ),
        ),
    )
    breaker = F.when(
        deal_breaker,
        entry(
            F.lit("Explicit deal-breaker confirmed"),
            F.lit("Resolve confirmed deal-breaker before reconsideration"),
        ),
    )
    return F.concat(F.array_compact(F.array(exam_gate)), open_items, F.array_compact(F.array(breaker)))


def outcome(composite_score: Column, gate_list: Column, deal_breaker: Column) -> Column:
    return (
        F.when(deal_breaker | (composite_score < 40), "Reject")
        .when(composite_score < 60, "Hold")
        .when(F.size(gate_list) > 0, "Conditional hire")
        .when(composite_score >= 75, "Hire")
        .otherwise("Hold")
    )
