"""Run registered queries against their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, fn, sql: str | None, inspect=None) -> tuple[str, int, float]:
    start = time.time()
    df = fn(spark, folder)
    if inspect:
        inspect(df)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    n = sum(got.values())
    if sql is None:
        return "rows-only", n, took
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", n, took
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"DIFF {n} vs {sum(want.values())} extra={extra} missing={missing}"[:900], n, took
    return "ok", n, took


def main() -> None:
    from rankmill.plans import ORACLE, QUERIES
    from rankmill.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    picked = [a for a in sys.argv[2:] if not a.startswith("-")]
    left_out = {a[1:] for a in sys.argv[2:] if a.startswith("-")}
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if name in left_out or (picked and not any(name.startswith(p) for p in picked)):
            continue
        try:
            verdict, n, took = compare(spark, con, folder, name, fn, ORACLE.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict, n, took = f"ERROR {type(e).__name__}: {str(e)[:500]}", -1, 0.0
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:42s} {n:8d} {took:6.2f}s {verdict}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
