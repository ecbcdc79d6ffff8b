"""Every registered query against its SQL, on the smallest tables."""

import re

import pytest
from compare import compare, connect

import __spark_entry__ as driver
from rankmill.plans import ORACLE as BASE_SQL
from rankmill.plans import QUERIES as BASE

FOLDER = "/root/testdata/sf0.001"
assert set(BASE) <= set(driver.queries())
QUERIES, SQL = BASE, BASE_SQL
# operators of the inventory, by letter
INVENTORY = {"a": 23, "b": 18, "c": 15, "d": 26, "e": 10, "f": 7, "s": 6, "h": 34, "m": 9, "t": 4, "k": 12}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def plan_is_distributed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for step in ("CartesianProduct", "NestedLoop", "BatchEvalPython"):
        assert step not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    """Same rows as the SQL, from a plan without cross products or row-wise Python."""
    verdict, n, _ = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name), plan_is_distributed)
    assert verdict in ("ok", "rows-only"), verdict
    assert n > 0 or name == "e06_gaps"


def test_every_operator_has_a_query():
    have = {re.match(r"[a-z]\d\d", name).group() for name in QUERIES}
    assert not [f"{k}{i:02d}" for k, n in INVENTORY.items() for i in range(1, n + 1) if f"{k}{i:02d}" not in have]


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", ["f01_sort_by_name", "f02_sort_by_years", "f03_missing_last", "f04_keep_rank_order", "f06_newest_first"])
def test_sort_order(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    order = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert [tuple(r) for r in df.collect()] == [tuple(r[i] for i in order) for r in cur.fetchall()]


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["job", "rank", "id", "total", "tier"] and df.count() > 0
