"""Ledger: merge, retention, search, figures, readers and writers."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from parapet import schemas
from parapet.functions import scalars as X
from parapet.operators import ledger as L
from parapet.sources import readers, writers
from tests.conftest import by

T0 = dt.datetime(2024, 1, 1)


def row(id, minute=0, request=None, source="ui", verdict="allowed", latency=10, filters=None):
    ts = None if minute is None else T0 + dt.timedelta(minutes=minute)
    return (id, ts, "clean", "native", filters, 200, verdict, latency, source, request)


def ledger(spark, rows):
    return spark.createDataFrame(rows, schemas.LEDGER)


def entry(id, minute=0, request="", **payload):
    ts = (T0 + dt.timedelta(minutes=minute)).isoformat() + "Z"
    return json.dumps({"insertId": id, "timestamp": ts, "jsonPayload": {"requestId": request, "httpStatus": "200", **payload}})


def test_log_rows(spark, tmp_path):
    lines = [
        entry("a", 1, "r/1", scenarioId="x<script>" + "y" * 99, httpStatus="400", latencyMs="12", filters="sdp", mode="native"),
        entry("b", 2, httpStatus="abc", latencyMs="0"), entry("c", 3, httpStatus="", scenarioId=""),
        json.dumps({"insertId": "d", "timestamp": "", "jsonPayload": "text"}), "not json",
    ]
    (tmp_path / "log.json").write_text("\n".join(lines))
    rows = by(readers.read_gateway_log(spark, str(tmp_path), limit=None).where("id is not null"), "id",
              "scenario_id", "http_status", "verdict", "latency_ms", "request_id", "filters")
    assert rows["a"] == ("xscript" + "y" * 57, 400, "blocked", 12, "r1", "sdp")
    assert rows["b"] == ("external", 0, "error", None, None, None)
    assert rows["c"] == ("external", 0, "error", None, None, None)
    assert rows["d"][:3] == ("external", 0, "error")
    newest = readers.read_gateway_log(spark, str(tmp_path), limit=2)
    assert {r.id for r in newest.collect()} == {"b", "c"}


def test_merge(spark):
    local = ledger(spark, [row("ui-1", 1, "r1"), row("ev-2", 2, "r2", L.EXTERNAL), row("ui-3", 3, None)])
    log = ledger(spark, [
        row("ev-1", 1, "r1", L.EXTERNAL), row("ev-2", 2, "r9", L.EXTERNAL), row("ev-4", 4, "r2", L.EXTERNAL), row("ev-5", 5, None, L.EXTERNAL),
        row(None, 6, "r6", L.EXTERNAL), row("", 7, "r7", L.EXTERNAL)])
    assert {r.id for r in L.new_entries(log, local).collect()} == {"ev-4", "ev-5"}
    assert {r.id for r in L.merge_log(local, log).collect()} == {"ui-1", "ev-2", "ui-3", "ev-4", "ev-5"}
    assert L.merge_log(local, log, pull=1).count() == 3


def test_newest_and_page(spark):
    df = ledger(spark, [row(f"{i:03}", i) for i in range(30)] + [row("none", None), row("tie", 29)])
    assert [r.id for r in L.newest(df, 3).collect()] == ["029", "tie", "028"]
    assert L.newest(df, 100).collect()[-1].id == "none"
    page = L.page(df, 5)
    assert page.columns == schemas.PUBLIC_LEDGER and "request_id" not in page.columns and page.count() == 5
    assert [r["rank"] for r in L.ranked(df, 4).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_search(spark):
    df = ledger(spark, [row("a", filters="sdp"), row("b", verdict="error")])
    ids = lambda q: {r.id for r in L.search(df, q).collect()}
    assert ids(" ") == {"a", "b"} and ids("SDP") == {"a"} and ids("native  error") == {"b"} and ids("native error") == set()
    assert ids("200") == {"a", "b"}


def test_kpis(spark):
    df = ledger(spark, [row("a"), row("b", verdict="error", latency=None), row("c", verdict="blocked", latency=20), row("d"), row("e"), row("f"),
                        row("g"), row("h")])
    got = L.kpis(df).first()
    assert (got.total, got.allowed, got.blocked, got.block_rate) == (8, 6, 2, 25) and got.mean_latency_ms == 80 / 8
    assert tuple(L.kpis(df.limit(0)).first()) == (0, 0, 0, 0, 0.0)
    half = L.kpis(ledger(spark, [row("a")] * 7 + [row("b", verdict="blocked")])).first()
    assert half.block_rate == 13


def test_telemetry(spark):
    body = json.dumps({"error": {"screening": {"matchedFilters": ["sdp", 3, "x<y"], "latencyMs": 7, "verdict": "blocked", "mode": "callout"}}})
    rows = [({"x-filters": "rai:a, none,,sdp", "x-latency-ms": "0", "x-verdict": "allowed", "x-mode": ""}, body), ({}, body), ({}, None),
            ({"x-latency-ms": "junk"}, None)]
    df = spark.createDataFrame(rows, "h map<string,string>, b string")
    got = [r[0] for r in df.select(L.telemetry(F.col("h"), F.col("b"), F.lit("native"))).collect()]
    assert (got[0].filters, got[0].latency_ms, got[0].verdict, got[0].mode) == (["rai:a", "sdp"], None, "allowed", "callout")
    assert (got[1].filters, got[1].latency_ms, got[1].verdict) == (["sdp", "xy"], 7, "blocked")
    assert (got[2].filters, got[2].mode, got[3].latency_ms) == ([], "native", None)


def test_audit_message_has_no_content(spark):
    df = spark.createDataFrame([("r", "secret prompt", "allowed")], "request_id string, text string, verdict string")
    assert L.audit_message(df, requestId=F.col("request_id"), verdict=F.col("verdict")).columns == ["requestId", "verdict"]


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert readers.read_ledger(spark, path).count() == 0
    df = ledger(spark, [row("a"), row("b")]).withColumn("text", F.lit("secret"))
    writers.append_ledger(df, path, "one")
    writers.append_ledger(df.where("id = 'a'"), path, "one")
    writers.append_ledger(df, path)
    stored = readers.read_ledger(spark, path)
    assert stored.count() == 3 and stored.schema.names == schemas.LEDGER.names
    assert readers.read_ledger(spark, path, without_run="one").count() == 2


def test_json_ledger(spark, tmp_path):
    path = tmp_path / "l.json"
    assert [d.count() for d in readers.read_json_ledger(spark, str(path))] == [0, 0]
    path.write_text('{"id":"a","http_status":200}\n{"id":\n\n{"id":"b","http_status":"x"}\n')
    good, bad = readers.read_json_ledger(spark, str(path))
    assert [r.id for r in good.collect()] == ["a"] and bad.count() == 2


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"x" * 50)
    (tmp_path / "c.bin").write_bytes(b"x")
    files = sorted((r.length, r.status, r.content is None, bool(r.reason)) for r in readers.read_files(spark, str(tmp_path), "*.txt", 20).collect())
    assert files == [(10, 200, False, False), (50, 413, True, True)]
    (tmp_path / "inv.csv").write_text("sku,region_hub,units_in_stock,wholesale_usd,lead_time_days\nM,Tokyo,310,12.50,4\n")
    assert str(readers.read_delimited(spark, str(tmp_path / "inv.csv")).first().wholesale_usd) == "12.50"
    (tmp_path / "req.json").write_text('{"contents":[{"parts":[{"text":"hi"}]}]}\nnope\n')
    got = readers.read_requests(spark, str(tmp_path / "req.json")).collect()
    assert sorted(r.n_contents for r in got) == [0, 1]
    (tmp_path / "res.json").write_text("{}\n")
    assert readers.read_results(spark, str(tmp_path / "res.json")).columns == ["result"]


def test_only_allowed_rows_are_forwarded(spark, tmp_path):
    items = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "id string, payload string")
    verdicts = spark.createDataFrame([("a", "allowed"), ("b", "blocked")], "id string, verdict string")
    assert [r.id for r in writers.allowed_only(items, verdicts, ["id"]).collect()] == ["a"]
    writers.write_forwarded(items.join(verdicts, "id"), str(tmp_path / "out"), ["id"])
    assert [r.id for r in spark.read.json(str(tmp_path / "out")).collect()] == ["a"]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert [value(X.mask_secret(lit(k))) for k in ("", "short", "longer-secret")] == ["", "••••", "••••cret"]
    assert value(X.mask_secret(lit(None).cast("string"))) == "" and value(X.mask_secret_ends(lit("a" * 12))) == "(not set)"
    assert value(X.mask_secret_ends(lit("abcd567890xyz"))) == "abcd…0xyz"
    assert [value(X.fmt_bytes(lit(n))) for n in (0, 1536, 1048576, 5 * 1048576)] == ["0.0 KB", "1.5 KB", "1.00 MB", "5.00 MB"]
    assert [value(X.int_or(lit(s), 3)) for s in ("7", "x", "true", " -2 ")] == [7, 3, 3, -2]
    assert [value(X.int_or_null(lit(s))) for s in ("7", "0", "x")] == [7, None, None]
    assert value(X.string_list(lit('["a", 1, null, "' + "b" * 70 + '"]'))) == ["a", "b" * 60] and value(X.string_list(lit("{}"))) == []
    assert [value(X.json_or(lit(s), "[]")) for s in ('{"a":1}', "{")] == ['{"a":1}', "[]"]
    assert [value(X.filter_label(lit(f))) for f in ("sdp", "rai:dangerous", "new:x")] == ["Sensitive data", "Responsible AI (dangerous)", "new:x"]
    assert [value(X.is_blank(lit(t))) for t in ("", " \t\n", "  ﻿", " a")] == [True, True, True, False]
    b64 = {"QUJD": True, "QUI=": True, "QQ==": True, "QUJ": False, "": False, "QU JD": False, "Q===": False, "QUJD\n": False, "QUJ-": False}
    assert {k: value(X.is_strict_base64(lit(k))) for k in b64} == b64
    assert value(X.base64_bytes(lit("QUI="))) == 3 and bytes(value(X.from_base64(lit("QUI=")))) == b"AB"
    names = {"a\\b/c d(1).txt": "c d(1).txt", "x/": "file", "é.png": "_.png", "a" * 130: "a" * 120}
    assert {k: value(X.safe_filename(lit(k), "file")) for k in names} == names
    exts = {"a.TXT": ".txt", "a.tar.gz": ".gz", ".txt": "", "none": "", "a.": ".", "..a.b": ".b"}
    assert {k: value(X.extension(lit(k))) for k in exts} == exts
    assert value(X.sniff_image(lit("/9j/x"), lit("o"))) == "image/jpeg" and value(X.sniff_image(lit("z"), lit("o"))) == "o"
    assert [value(X.check_millis(lit(a), lit(b))) for a, b in ((5, 9), (9, 5), (0, 9), (None, 9))] == [4, 0, 0, 0]
    assert [value(X.latency_delta(lit(a), lit(b))) for a, b in ((5, 9), (0, 9))] == [4, None]
    assert value(X.clean_label(lit("a<b>c:1,-. é"), 6)) == "abc:1," and value(X.clean_label(lit(None).cast("string"))) == ""
    assert bytes(value(F.unhex(F.hex(F.encode(lit("é"), "UTF-8"))))) == "é".encode()
    assert value(X.decode_utf8(lit(b"\xef\xbb\xbfhi"))) == "hi" and value(X.decode_utf8(lit(b"\xff"))) is None
    assert value(X.normalize_lines(lit(" a   b\r\n\n  \n​c\u0007\t\n"))) == "a b\nc"
    assert [value(X.forwarded_state(lit(n), lit(f))) for n, f in ((None, True), (1, False), (1, True))] == ["n/a", "note only", "yes"]


def test_runs_are_published_whole_and_compacted(spark, tmp_path):
    path = str(tmp_path / "ledger")
    row = lambda i, day: (f"id{i}", dt.datetime(2024, 1, day), "s", "native", None, 200, "allowed", 1, "ui", f"r{i}")
    rows = lambda *r: spark.createDataFrame(list(r), schemas.LEDGER)
    writers.compact_ledger(spark, path)
    writers.append_ledger(rows(row(1, 1), row(2, 2)), path, "a")
    writers.append_ledger(rows(row(3, 3)), path, "b")
    writers.append_ledger(rows(row(4, 4), row(5, 5)), path, "a")
    assert sorted(r.id for r in readers.read_ledger(spark, path).collect()) == ["id3", "id4", "id5"]
    writers.compact_ledger(spark, path, keep=2)
    assert sorted(r.id for r in readers.read_ledger(spark, path).collect()) == ["id4", "id5"]
    assert len(readers.live_runs(spark, path)) == 1
    writers.vacuum_ledger(spark, path, 0)
    assert len([p for p in os.listdir(path) if p.startswith("run=")]) == 1
    assert sorted(r.id for r in readers.read_ledger(spark, path).collect()) == ["id4", "id5"]
