"""Damaged and late input: unreadable files and lines are named, late rows are kept, retries replace."""

import glob
import json
import uuid

from pyspark.sql import functions as F

from parapet import schemas
from parapet.sources import readers, writers
from parapet.streaming import jobs as J
from tests.test_ledger import ledger, row
from tests.test_streaming import stream


def test_a_cut_off_file_costs_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert [d.count() for d in readers.read_ledger_checked(spark, path)] == [0, 0]
    writers.append_ledger(ledger(spark, [row(f"a{i}", i) for i in range(20)]).repartition(2), path, "one")
    writers.append_ledger(ledger(spark, [row(f"b{i}", i) for i in range(5)]).coalesce(1), path, "two")
    good, bad = readers.read_ledger_checked(spark, path)
    assert good.count() == 25 and bad.count() == 0
    cut, flipped = sorted(glob.glob(f"{path}/run=one*/*.parquet"))[0], glob.glob(f"{path}/run=two*/*.parquet")[0]
    lost = {r.id for r in spark.read.parquet(cut).collect()} | {f"b{i}" for i in range(5)}
    for file, damage in ((cut, lambda b: b[: len(b) // 2]), (flipped, lambda b: b[:4] + bytes(60) + b[64:])):
        content = open(file, "rb").read()
        open(file, "wb").write(damage(content))
        crc = f"{file.rsplit('/', 1)[0]}/.{file.rsplit('/', 1)[1]}.crc"
        open(crc, "wb").write(b"")
    good, bad = readers.read_ledger_checked(spark, path)
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {cut.rsplit("/", 1)[1], flipped.rsplit("/", 1)[1]}
    assert {r.id for r in good.collect()} == {f"a{i}" for i in range(20)} - lost


def test_bad_lines_are_returned(spark, tmp_path):
    (tmp_path / "inv.csv").write_text("sku,region_hub,units_in_stock,wholesale_usd,lead_time_days\nM,Tokyo,310,12.50,4\nN,Oslo,many,1.00,2\nO,Rome,1\n")
    good, bad = readers.read_delimited_checked(spark, str(tmp_path / "inv.csv"))
    assert [r.sku for r in good.collect()] == ["M"] and good.columns == schemas.INVENTORY.names
    assert sorted(r.bad_line for r in bad.collect()) == ["N,Oslo,many,1.00,2", "O,Rome,1"]


def test_the_newest_by_time_with_ties_in_one_order(spark, tmp_path):
    times = ["2024-01-01T10:00:00+02:00", "2024-01-01T09:00:00Z", "2024-01-01T08:30:00Z", "2024-01-01T09:00:00.000Z", "junk", None]
    lines = [json.dumps({"insertId": f"e{i}", "timestamp": t, "jsonPayload": {}}) for i, t in enumerate(times)]
    (tmp_path / "log.json").write_text("\n".join(lines))
    entries = readers.read_gateway_log(spark, str(tmp_path), limit=3)
    assert {r.id for r in entries.collect()} == {"e1", "e3", "e2"}
    assert {r.id for r in readers.read_gateway_log(spark, str(tmp_path), limit=1).collect()} == {"e1"}


def test_a_repeated_run_forwards_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", "allowed"), ("b", "p", "blocked"), ("c", "p", "allowed")], "id string, payload string, verdict string")
    out = str(tmp_path / "out")
    for _ in range(2):
        writers.write_forwarded(rows, out, ["id"], run="forward-0")
    writers.write_forwarded(rows.where("id = 'a'").withColumn("id", F.lit("d")), out, ["id"], run="forward-1")
    assert sorted(r.id for r in spark.read.json(out).collect()) == ["a", "c", "d"]


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    out, batches = str(tmp_path / "split"), [[row("a", 600), row("b", 10)], [row("late", 500), row("edge", 540), row("c", 700), row("none", None)], [row("late2", 0)]]
    df = stream(spark, tmp_path, batches, schemas.LEDGER)
    J.split_late(df, out, f"split-{uuid.uuid4().hex}").awaitTermination(120)
    ids = lambda side: sorted(r.id for r in spark.read.parquet(f"{out}/{side}").collect())
    assert ids("late") == ["late", "late2"] and ids("on_time") == ["a", "b", "c", "edge", "none"]
    marks = {r.batch: (r.n_on_time, r.n_late) for r in spark.read.parquet(f"{out}/marks").collect()}
    assert marks == {0: (2, 0), 1: (3, 1), 2: (0, 1)}
