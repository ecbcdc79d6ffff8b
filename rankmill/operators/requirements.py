"""Rules that turn a job text into requirement lists, and rubric cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmill.functions.arrays import bind, first_by_lower
from rankmill.functions.text import WS, trim_ws

# Line patterns and the sentences they stand for.
SKIP_LINE = (
    r"\A(how to apply|email|mobile|phone|tel|positions?:|responsibilit|qualifications?"
    r"|requirements?|location:)"
)
COMPANY_BLURB = "leading company|looking to hire|based in|landscap|nursery|nurseries"
REQUIREMENT_HINT = (
    "bachelor|degree|diploma|master|erp|zoho|sap|oracle|odoo|dynamics|vat|ifrs|excel|account"
    "|reconcil|payable|receivable|abu dhabi|uae|year|budget|audit|ledger|payroll"
)
SYNTHESIZED = (
    ("bachelor|degree", "Bachelor's degree in Accounting or Finance"),
    ("erp|zoho|sap|oracle|odoo|dynamics", "ERP (Zoho, SAP, Oracle, Dynamics, or Odoo)"),
    ("vat|uae regulation", "UAE VAT / FTA compliance"),
    ("payable|receivable|ap/ar|reconcil", "AP/AR and reconciliations"),
    ("abu dhabi", "Based in or willing to work in Abu Dhabi"),
)
EDUCATION = (("bachelor", "Bachelor's degree"), ("diploma", "Diploma"), ("master", "Master's degree"))
DUAL_TRACK_NICE = "5+ years and senior-track leadership for Senior Accountant"
MUST_CAP = 6
LINE_CAP = 8


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iu){pattern}")


def dual_track(title: Column, description: Column) -> Column:
    blob = F.concat_ws("\n", title, description)
    edge_l, edge_r = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    return _has(blob, f"{edge_l}senior{edge_r}") & _has(blob, f"{edge_l}junior{edge_r}")


def requirement_lines(description: Column) -> Column:
    cleaned = F.transform(
        F.split(description, "\n+"),
        lambda ln: trim_ws(F.regexp_replace(ln, rf"\A[•*\-–{WS}]++", "")),
    )
    kept = F.filter(
        cleaned,
        lambda ln: F.length(ln).between(8, 160)
        & ~_has(ln, SKIP_LINE) & ~_has(ln, COMPANY_BLURB) & _has(ln, REQUIREMENT_HINT),
    )
    return F.slice(kept, 1, LINE_CAP)


def synthesized(description: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(_has(description, p), F.lit(text)) for p, text in SYNTHESIZED])
    )


def years_required(description: Column, dual: Column) -> Column:
    found = F.regexp_extract_all(description, F.lit(rf"(?i)(?<![0-9])([0-9]++){WS}*+\+?{WS}*+years?"), F.lit(1))
    usable = F.filter(F.transform(found, lambda y: y.try_cast("int")), lambda y: (y > 0) & (y < 40))
    return F.when(dual, F.array_min(usable)).otherwise(F.get(usable, F.lit(0)))


def education_required(description: Column) -> Column:
    out = F.when(_has(description, EDUCATION[0][0]), EDUCATION[0][1])
    for pattern, value in EDUCATION[1:]:
        out = out.when(_has(description, pattern), value)
    return out


def must_have(description: Column) -> Column:
    both = F.concat(synthesized(description), requirement_lines(description))
    return F.slice(first_by_lower(both), 1, MUST_CAP)


def nice_to_have(description: Column, dual: Column) -> Column:
    rest = bind(
        requirement_lines(description),
        lambda ls: F.when(F.size(ls) > MUST_CAP, F.slice(ls, MUST_CAP + 1, LINE_CAP)).otherwise(F.slice(ls, 1, 0)),
    )
    return F.when(dual, F.array(F.lit(DUAL_TRACK_NICE))).otherwise(rest)


def location_required(description: Column, scope: Column) -> Column:
    return F.when(_has(description, "abu dhabi"), "Abu Dhabi").otherwise(scope)


# --- rubric cleaning ---------------------------------------------------------


def clean_text(c: Column) -> Column:
    t = trim_ws(c)
    return F.when((F.length(t) > 0) & (F.lower(t) != "null"), t)


def clean_list(c: Column) -> Column:
    return F.filter(F.transform(c, clean_text), lambda x: x.isNotNull())


def clean_required(c: Column, fallback: str) -> Column:
    return F.coalesce(clean_text(c), F.lit(fallback))


def weights_or_default(weights: dict[str, Column], defaults: dict[str, float]) -> dict[str, Column]:
    """All weights present: keep them; any missing (an old shape): all defaults."""
    complete = F.lit(True)
    for c in weights.values():
        complete = complete & c.isNotNull()
    return {k: F.when(complete, c).otherwise(F.lit(defaults[k])) for k, c in weights.items()}
