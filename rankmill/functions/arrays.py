"""Array helpers for work that stays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a lambda variable.

    Without it a nested array function would evaluate ``value`` again for every
    element it visits.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def indexed(items: Column) -> Column:
    """Elements as (i, x) structs."""
    return F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


def run_lengths(items: Column) -> Column:
    """Distinct elements with their counts as (x, n), by sorting: n log n."""

    def count(s: Column) -> Column:
        starts = F.filter(
            indexed(s), lambda r: (r["i"] == 0) | (r["x"] != F.get(s, r["i"] - 1))
        )
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda r, k: F.struct(
                    r["x"].alias("x"),
                    (F.coalesce(F.get(st, k + 1)["i"], F.size(s)) - r["i"]).alias("n"),
                ),
            ),
        )

    return bind(F.sort_array(items), count)


def first_by_lower(items: Column) -> Column:
    """Case-insensitive distinct, first spelling kept, order kept (short lists)."""
    return F.aggregate(
        items,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc
        ).otherwise(F.array_append(acc, x)),
    )
