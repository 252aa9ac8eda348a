"""Streams give what the batch functions give on the same rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from parapet import schemas
from parapet.operators import ledger as L
from parapet.plans.audit import windowed
from parapet.sources.readers import read_ledger
from parapet.streaming import jobs as J
from tests.conftest import by
from tests.test_ledger import T0, row

FAR = 60 * 24 * 30


def stream(spark, tmp_path, batches, schema, name="in"):
    """A stream that reads one batch of rows per trigger."""
    folder = str(tmp_path / name)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b={i}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{folder}/b=*")


def collect(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_screening_equals_batch(spark, tmp_path):
    bodies = [json.dumps({"contents": [{"parts": [{"text": t}]}]}) for t in ("hi", "you idiot", " ", "x" * 9000)] + ["nope"]
    rows = list(enumerate(bodies))
    schema = "id int, body string"
    batch = by(J.screen_stream(spark.createDataFrame(rows, schema)), "id", "verdict", "filters")
    got = by(collect(spark, J.screen_stream(stream(spark, tmp_path, [rows[:2], rows[2:]], schema)), "screened", tmp_path), "id", "verdict", "filters")
    assert got == batch == {0: ("allowed", "none"), 1: ("blocked", "rai:harassment"), 2: ("error", "none"), 3: ("error", "none"), 4: ("error", "none")}


def test_repeats_are_dropped(spark, tmp_path):
    rows = [row(f"e{i}", i) for i in range(50)]
    df = stream(spark, tmp_path, [rows[:30], rows[20:] + [row(None, 1), row("", 1)]], schemas.LEDGER)
    out = collect(spark, J.dedupe_log(df), "deduped", tmp_path)
    assert out.count() == 50 and out.select("id").distinct().count() == 50


def test_windows_equal_batch_and_late_rows_are_dropped(spark, tmp_path):
    first = [row(f"a{i}", i * 7, verdict="allowed" if i % 3 else "error") for i in range(60)]
    late, end = [row("late", 0)], [row("end", FAR)]
    df = stream(spark, tmp_path, [first, [row("tick", 600)], late, end], schemas.LEDGER)
    got = by(collect(spark, J.kpis_by_window(df), "windows", tmp_path), "window_start", "total", "allowed", "block_rate")
    batch = spark.createDataFrame(first + [row("tick", 600)], schemas.LEDGER).groupBy(F.window("ts", "1 hour")).agg(*L.kpi_columns())
    want = {r.window.start: (r.total, r.allowed, r.block_rate) for r in batch.collect()}
    assert got == want


def test_sessions_close(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, at(0)), (1, at(20)), (1, at(100)), (2, at(5)), (3, at(FAR))]
    df = stream(spark, tmp_path, [rows[:2], rows[2:4], rows[4:]], "user_id int, ts timestamp")
    got = {(r.user_id, r.session_start, r.n_events) for r in collect(spark, J.sessions_by_user(df), "sess", tmp_path).collect()}
    assert got == {(1, at(0), 2), (1, at(100), 1), (2, at(5), 1)}


def test_windowed_query_runs_on_streams(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    schema = "ts timestamp, event_type string, value double"
    rows = [(at(i * 11), "error" if i % 2 else "view", 1.5) for i in range(20)]
    got = collect(spark, windowed(stream(spark, tmp_path, [rows[:9], rows[9:]], schema), "1 hour"), "tumble", tmp_path, "complete")
    want = windowed(spark.createDataFrame(rows, schema), "1 hour")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(got) == key(want)


def test_results_out_of_time_are_incomplete(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = stream(spark, tmp_path, [[("a", 1, at(0)), ("b", 1, at(0)), ("c", 1, at(0))], [("z", 1, at(9000))], [("z", 2, at(9999))]],
                   "request_id string, n int, part_ts timestamp", "parts")
    results = stream(spark, tmp_path, [[("a", 1, at(25), "allowed"), ("b", 1, at(26), "allowed")], [("y", 1, at(9000), "allowed")], [("y", 2, at(9999), "allowed")]],
                     "request_id string, n int, result_ts timestamp, verdict string", "results")
    got = by(collect(spark, J.await_results(parts, results), "awaited", tmp_path).where("request_id < 'x'"), "request_id", "verdict")
    assert got == {"a": "allowed", "b": "incomplete", "c": "incomplete"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = stream(spark, tmp_path, [[row("ui-1", 1, "r1")], [row("ui-2", 2, "r2")]], schemas.LEDGER)
    J.audit_sink(rows.withColumn("text", F.lit("secret")), path, f"audit{tmp_path.name}").awaitTermination(120)
    assert {r.id for r in read_ledger(spark, path).collect()} == {"ui-1", "ui-2"}
    assert "text" not in spark.read.parquet(path).columns
    log = [row("ev-1", 1, "r1", L.EXTERNAL), row("ev-3", 3, "r3", L.EXTERNAL), row("ev-3", 3, "r3", L.EXTERNAL)]
    source = stream(spark, tmp_path, [log, [row("ev-3", 3, "r3", L.EXTERNAL), row("ev-4", 4, None, L.EXTERNAL)]], schemas.LEDGER, "log")
    J.merge_sink(source, path, f"merge{tmp_path.name}").awaitTermination(120)
    assert sorted(r.id for r in read_ledger(spark, path).collect()) == ["ev-3", "ev-4", "ui-1", "ui-2"]
