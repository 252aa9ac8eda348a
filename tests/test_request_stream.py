"""Requests whose parts arrive one by one: the stream gives the batch fold in any order of arrival."""

import datetime as dt
import random

import pytest

from parapet.streaming import requests as R
from tests.conftest import by
from tests.test_streaming import collect, stream

T0 = dt.datetime(2024, 1, 1)
PARTS = "request_id string, request_ts timestamp, n_parts int, n int, part_ts timestamp, verdict string, filters array<string>"
COLUMNS = ("n_expected", "n_parts", "verdict", "matched", "over_limit")


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def part(request, n, verdict="allowed", filters=(), n_parts=3, start=0, after=1):
    return (request, at(start), n_parts, n, at(start + after), verdict, list(filters))


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


CASES = [
    *[part("clean", n) for n in (1, 2, 3)],
    *[part("blocked", 1), part("blocked", 2, "blocked", ["rai:harassment", "sdp"]), part("blocked", 3, "blocked", ["sdp"])],
    *[part("missing", 1), part("missing", 3)],
    *[part("missing-blocked", 2, "blocked", ["sdp"])],
    *[part("unscreened", 1), part("unscreened", 2, "incomplete"), part("unscreened", 3)],
    *[part("late", 1), part("late", 2), part("late", 3, after=26)],
    *[part("limit", 1), part("limit", 2), part("limit", 3, after=25)],
    *[part("again", 1), part("again", 1), part("again", 2), part("again", 2), part("again", 3), part("again", 1, after=3)],
    *[part("announced", None), part("empty", None, n_parts=0), part("unknown", 1, n_parts=None)],
    *[part("many", n, n_parts=6) for n in range(1, 7)],
    *[part("single", 1, n_parts=1)],
]


def test_batch(spark):
    got = by(R.fold_requests(spark.createDataFrame(CASES, PARTS)), "request_id", *COLUMNS)
    assert got == {
        "clean": (3, 3, "allowed", "none", False), "blocked": (3, 3, "blocked", "p2:rai:harassment,p2:sdp,p3:sdp", False),
        "missing": (3, 2, "incomplete", "none", False), "missing-blocked": (3, 1, "blocked", "p2:sdp", False),
        "unscreened": (3, 3, "incomplete", "none", False), "late": (3, 2, "incomplete", "none", False), "limit": (3, 3, "allowed", "none", False),
        "again": (3, 3, "allowed", "none", False), "announced": (3, 0, "incomplete", "none", False), "empty": (0, 0, "incomplete", "none", False),
        "unknown": (None, 1, "incomplete", "none", False), "many": (6, 6, "allowed", "none", True), "single": (1, 1, "allowed", "none", False),
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stream_equals_batch_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = r.sample(CASES, len(CASES))
    cuts = sorted(r.sample(range(1, len(rows)), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    end = part("end", 1, n_parts=1, start=90_000)
    df = stream(spark, tmp_path, [*batches, [end]], PARTS)
    got = by(collect(spark, R.fold_request_stream(df), f"folded{seed}", tmp_path).where("request_id <> 'end'"), "request_id", *COLUMNS)
    assert got == by(R.fold_requests(spark.createDataFrame(CASES, PARTS)), "request_id", *COLUMNS)
    assert spark.table(f"folded{seed}").count() == len(got) + 1


def test_state_is_bounded_by_open_requests(spark, tmp_path):
    """A thousand requests, each closed before the next hundred start: the state holds the last ones only."""
    batches = [[part(f"r{b}-{i}", n, start=b * 3600) for i in range(100) for n in (1, 2 + i % 2)] for b in range(6)]
    df = stream(spark, tmp_path, [*batches, [part("end", 1, n_parts=1, start=90_000)]], PARTS)
    q = R.fold_request_stream(df).writeStream.format("memory").queryName("bounded").option("checkpointLocation", str(tmp_path / "cp"))
    q = q.trigger(availableNow=True).start()
    q.awaitTermination(240)
    rows = spark.table("bounded")
    assert rows.where("verdict = 'incomplete'").count() == 600 and rows.count() == 601
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(held) <= 4 * 200 + 10 and held[-1] <= 10


def test_text_is_screened_before_the_state(spark):
    schema = "request_id string, request_ts timestamp, n_parts int, n int, part_ts timestamp, text string"
    rows = [("a", T0, 2, 1, T0, "hello"), ("a", T0, 2, 2, T0, "you idiot"), ("b", T0, 1, 1, T0, None)]
    parts = R.screened_parts(spark.createDataFrame(rows, schema))
    assert "text" not in parts.columns
    assert by(R.fold_requests(parts), "request_id", "verdict", "matched") == {"a": ("blocked", "p2:rai:harassment"), "b": ("incomplete", "none")}


def test_needs_a_state_store_with_timers(spark):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError):
        R.fold_request_stream(spark.createDataFrame(CASES, PARTS))
