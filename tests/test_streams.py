"""Streams over several batches give what one batch job gives."""

import datetime as dt
import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rankmill.operators import tracking
from rankmill.plans import ORACLE, QUERIES
from rankmill.sources.folders import subfolders
from rankmill.streaming import budget, live, reuse
from rankmill.streaming.keyed_table import KeyedTable

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in five files, in the order of time."""
    path = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    edges = [r[0] for r in events.selectExpr("explode(percentile(event_id, array(0.2, 0.4, 0.6, 0.8)))").collect()]
    for i, (lo, hi) in enumerate(zip([-1, *edges], [*edges, 10**12])):
        events.where((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.parquet(str(path / f"part{i}"))
    return path, events


def stream(spark, folder):
    path, events = folder
    return live.read_new_files(spark, f"{path}/*", events.schema, maxFilesPerTrigger=1)


SPAN = 172_800


def decided_by_hand(events, limit=3):
    """Sequential walk over all events in the order of time."""
    want, state = {}, {}
    for r in events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).orderBy("at").collect():
        opened, used = state.get(r["user_id"], (None, 0))
        if opened is None or r["at"] - opened >= SPAN * 1_000_000:
            opened, used = r["at"], 0
        ok = used < limit
        state[r["user_id"]] = (opened, used + ok)
        want[r["at"]] = (int(ok), opened)
    return want


def run_budget(spark, path, schema, progress, out, delay):
    own = budget.own_session(spark)
    source = live.read_new_files(own, f"{path}/*", schema, maxFilesPerTrigger=1)
    live.append_available(budget.throttle(source, "s", "user_id", "ts", 3, SPAN, delay), out, progress)
    done = own.read.schema(budget.OUTPUT).parquet(out)
    return own, done


def test_budget_of_files_out_of_order(spark, folder, tmp_path):
    """Files arrive shuffled; with a delay that covers the disorder every decision is the one of the ordered walk."""
    _, events = folder
    rows = events.orderBy("ts").collect()
    cut = len(rows) // 6
    parts = [rows[i * cut : (i + 1) * cut] if i < 5 else rows[5 * cut :] for i in range(6)]
    for i in (2, 0, 1, 4, 3, 5):
        spark.createDataFrame(parts[i], events.schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
        time.sleep(0.05)
    own, done = run_budget(spark, tmp_path / "in", events.schema, str(tmp_path / "progress"), str(tmp_path / "out"), "60 days")
    rest = budget.undecided(own, str(tmp_path / "progress"), 3, SPAN)
    got = {r["at_us"]: (r["allowed"], r["opened_us"]) for r in done.unionByName(rest).collect()}
    want = decided_by_hand(events)
    assert got == want and 0 in {a for a, _ in want.values()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def test_budget_state_of_idle_keys_ends(spark, tmp_path):
    """A restart goes on from the state; a key idle for one window has none left."""
    schema = "user_id long, ts timestamp"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    first = [(1, day(0)), (1, day(0.5)), (1, day(1)), (1, day(1.2)), (2, day(1))]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in/p0"))
    at = [str(tmp_path / x) for x in ("progress", "out")]
    own, done = run_budget(spark, tmp_path / "in", schema, *at, "1 hour")
    assert {r["used"] for r in budget.open_windows(own, at[0]).collect()} == {1, 3}
    spark.createDataFrame([(2, day(1.5)), (3, day(30))], schema).coalesce(1).write.parquet(str(tmp_path / "in/p1"))
    own, done = run_budget(spark, tmp_path / "in", schema, *at, "1 hour")
    assert budget.open_windows(own, at[0]).count() == 0  # user 3 still waits for its decision, nobody else has state
    rest = budget.undecided(own, at[0], 3, SPAN).collect()
    assert len(rest) == 1 and rest[0]["allowed"] == 1
    assert sorted(r["allowed"] for r in done.collect()) == [0, 1, 1, 1, 1, 1]


def test_budget_waits_in_few_elements(spark, tmp_path):
    """What a key waits with is packed: an element for the arrivals of a batch, not one for each instant."""
    begin = dt.datetime(2024, 1, 1)
    rows = [(i % 2, begin + dt.timedelta(seconds=i // 4)) for i in range(400)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in/p0"))
    progress = str(tmp_path / "progress")
    own, done = run_budget(spark, tmp_path / "in", "user_id long, ts timestamp", progress, str(tmp_path / "out"), "1 hour")
    assert done.count() == 0 and budget._state(own, progress, "waiting").count() == 2
    rest = budget.undecided(own, progress, 3, SPAN).collect()
    assert len(rest) == 200 and {r["offered"] for r in rest} == {2} and sum(r["allowed"] for r in rest) == 6


def test_counters_merge_by_key(spark, folder, tmp_path):
    _, events = folder
    table = KeyedTable(str(tmp_path / "table"), ("user_id",), "user_id long, total long, n_view long, n_error long")
    rows = live.counters(stream(spark, folder), "user_id", "event_type", ["view", "error"])
    batches = []

    def twice(batch, batch_id):  # every batch is replayed at once, and batch 0 again after batch 2
        kept = batch.select("*").collect()
        batches.append(kept)
        for n in (batch_id, batch_id, *([0] if batch_id == 2 else [])):
            table.merge(spark.createDataFrame(batches[n], batch.schema), n)

    live.merge_available(rows, twice, str(tmp_path / "progress"), "update")
    want = sorted(map(tuple, live.counters(events, "user_id", "event_type", ["view", "error"]).collect()))
    assert len(batches) >= 5 and len(subfolders(spark, table.path)) == len(batches)
    assert sorted(map(tuple, table.read(spark).drop("batch").collect())) == want
    for _ in range(2):
        table.compact(spark)
        assert subfolders(spark, table.path) == [f"base-{len(batches) - 1}"]  # no old folders
        assert sorted(map(tuple, table.read(spark).drop("batch").collect())) == want
    table.merge(spark.createDataFrame(batches[1], "user_id long, total long, n_view long, n_error long"), 1)  # held by the base: nothing
    assert sorted(map(tuple, table.read(spark).drop("batch").collect())) == want and len(subfolders(spark, table.path)) == 1
    table.merge(spark.createDataFrame([(-5, 1, 1, 0)], table.schema), 99)
    assert table.read(spark).count() == len(want) + 1
    assert KeyedTable(str(tmp_path / "none"), ("user_id",), table.schema).read(spark).count() == 0


def test_throughput_closes_windows_and_keeps_late_rows(spark, tmp_path):
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    files = [[0, 1, 2], [10, 3, 4], [11, 5, 1], [20, 2, 11.5], [9.5, 21, 3], [30, 0, 28.5]]
    for i, f in enumerate(files):
        spark.createDataFrame([(hour(h), int(h)) for h in f], "at timestamp, value long").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
        time.sleep(0.05)

    def source():
        return live.read_new_files(spark, f"{tmp_path}/in/*", "at timestamp, value long", maxFilesPerTrigger=1)

    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    held = []
    for _ in range(2):  # the second run finds nothing new
        live.append_available(live.throughput(source(), "at", "value", late="2 hours"), out, progress)
        held.append(live.open_windows(spark, progress).count())
    late = live.LateRows(str(tmp_path / "late"), "at", late="2 hours")
    live.merge_available(source(), late.put, str(tmp_path / "late-progress"))
    schema = spark.createDataFrame([], "at timestamp, value long").schema
    behind = late.read(spark, schema)
    assert sorted((r["batch"], r["at"]) for r in behind.collect()) == [(3, hour(2)), (4, hour(3)), (5, hour(0))]
    closed = spark.read.schema("hour timestamp, items long, tokens long").parquet(out)
    still = live.open_windows(spark, progress)
    assert held == [2, 2] and {r["hour"] for r in still.collect()} == {hour(28), hour(30)}  # state fell to what is open
    assert closed.count() == closed.select("hour").distinct().count()
    total = closed.unionByName(still).agg(F.sum("items").alias("n"), F.sum("tokens").alias("t")).first()
    gone = behind.agg(F.count("*").alias("n"), F.sum("value").alias("t")).first()
    assert total["n"] + gone["n"] == 18 and total["t"] + gone["t"] == sum(int(h) for f in files for h in f)
    late.put(source_batch(spark, tmp_path / "in/p4"), 4)  # a replay overwrites its own rows
    assert late.read(spark, schema).count() == 3


def source_batch(spark, path):
    return spark.read.schema("at timestamp, value long").parquet(str(path))


def test_intake_reuses_inside_the_stream(spark, tmp_path):
    rng = random.Random(1)
    texts = [f"{i % 7} " + "word " * 40 for i in range(28)] + ["tiny", "tiny", None, ""]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    for b in range(4):
        spark.createDataFrame(rows[b * 8 : b * 8 + 8], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"in/b{b}"))
        time.sleep(0.05)
    holders = reuse.Holders(str(tmp_path / "holders"))
    known = spark.createDataFrame([(texts[3], 900), ("tiny", 901)], "text string, doc_id long")
    holders.add(reuse.first_holders(known, "doc_id"), -1)
    intake = reuse.Intake(holders, str(tmp_path / "out"), "doc_id")
    source = live.read_new_files(spark, f"{tmp_path}/in/*", "doc_id long, text string", maxFilesPerTrigger=1)
    live.merge_available(source, intake.admit, str(tmp_path / "progress"))
    schema = "doc_id long, content_hash string, reused_from long, parse_status string"
    want, first = {}, {texts[3]: 900}
    for b in range(4):
        part = sorted(rows[b * 8 : b * 8 + 8])
        for i, t in part:
            if t and t != "tiny":
                first.setdefault(t, i)
        want |= {i: (first[t] if first.get(t, i) != i else None, "parsed" if t and t != "tiny" else "needs_ocr") for i, t in part}

    def got():
        return {r["doc_id"]: (r["reused_from"], r["parse_status"]) for r in intake.results(spark, schema).collect()}

    assert got() == want and sum(r[0] == 900 for r in want.values()) == 4
    for b in (3, 1):  # replayed batches change nothing
        intake.admit(spark.createDataFrame(rows[b * 8 : b * 8 + 8], "doc_id long, text string"), b)
        assert got() == want
    prefixes = [r[0] for r in spark.createDataFrame([(texts[3],)], "t string").select(F.substring(F.sha2("t", 256), 1, 2)).collect()]
    plan = holders.known(spark, prefixes, 3)._jdf.queryExecution().executedPlan().toString()
    assert f"prefix IN ({prefixes[0]})" in plan.replace("#", " ").replace("  ", " ") or "PartitionFilters" in plan and prefixes[0] in plan


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filtered(spark):
    text = plan(spark, "a01_table_scan")
    assert "EqualTo(c_mktsegment,BUILDING)" in text and "c_nationkey" not in text


@pytest.mark.parametrize("name", ["h01_scrub", "h07_shorten_by_section", "s02_distinct_lines", "d21_keyword_ratio", "h14_ranges_in_text"])
def test_text_work_needs_no_regrouping(spark, name):
    """Text stays in its row: the only exchanges spread a small file or fetch job rows."""
    text = plan(spark, name)
    assert "Window" not in text and "ArrowEvalPython" not in text


def test_counters_combine_before_the_shuffle(spark):
    df = tracking.stage_counters(
        spark.range(10).selectExpr("id % 2 as job", "'parsed' as parse_status", "'scored' as stage_status"), "job"
    )
    assert "partial_count" in df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_several_files(spark, tmp_path):
    """A table may be a folder of files; the streams read all of them."""
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {tuple(r) for r in QUERIES["t03_incremental_intake"](spark, str(tmp_path)).collect()}
    want = {tuple(r) for r in QUERIES["t03_incremental_intake"](spark, FOLDER).collect()}
    assert got == want and len(want) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_intake_of_files_in_any_order(spark, tmp_path, monkeypatch):
    """Of copies in different batches the smallest id is the first, whichever file comes first; null texts and ids as in the SQL."""
    long = ["word " * 40 + str(i) for i in range(4)]
    files = [[(9, long[0]), (8, long[1]), (7, "tiny"), (None, long[0])], [(6, long[0]), (5, None), (4, "tiny"), (3, long[2])], [(2, long[1]), (1, long[0]), (0, long[2])]]
    for rows in files:
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
        time.sleep(0.05)
    spark.createDataFrame([(3,), (4,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(live, "MAX_BATCH", 1)  # a file a batch
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["t03_incremental_intake"](spark, str(tmp_path)).select("doc_id", "content_hash", "reused_from", "parse_status")
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(ORACLE["t03_incremental_intake"]).fetchall())
    assert {(r["doc_id"], r["reused_from"]) for r in got.collect()} >= {(9, 1), (6, 1), (8, 2), (0, 3), (None, 1)}


def test_history_shuffles_hashes_only(spark):
    """Marked rows are found by hash and id; their texts stay in the scan."""
    docs, marked = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    held = reuse.first_holders(docs, "doc_id", marked)
    text = held._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join LeftSemi") < text.index("sha2(")
    want = reuse.first_holders(docs.join(marked.select("doc_id"), "doc_id", "left_semi"), "doc_id")
    assert {tuple(r) for r in held.collect()} == {tuple(r) for r in want.collect()} and held.count()
