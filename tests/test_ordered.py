"""Ordered operators against brute force, with one key holding most rows and tiny ranges."""

import bisect
import random

from pyspark.sql import functions as F

from parapet.operators import ordered as O
from tests.conftest import by

rnd = random.Random(7)
KEYS = ["hot"] * 6 + ["a", "b", "c"]


def test_number_rows(spark):
    rows = [(rnd.choice(KEYS + [None]), t) for t in rnd.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "k string, t int")
    want = {t: sorted(x for k2, x in rows if k2 == k).index(t) + 1 for k, t in rows}
    assert by(O.number_rows(df, ["k"], "t", most=50), "t", "n") == want


def test_ranges_follow_the_values(spark):
    """A million microsecond values with a burst: about sqrt(n) ranges, none of them large, in the values' order."""
    n = 1_000_000
    at = F.when(F.col("id") % 2 == 0, F.col("id") * 1_000_003).otherwise(F.lit(10**11) + F.col("id")).alias("t")
    rows = spark.range(n).select(F.struct(F.lit("hot")).alias("__key"), at)
    cut = O.with_ranges(rows, "t", O.hot_borders(rows, "t")).groupBy("__range").agg(
        F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))
    ranges = sorted(map(tuple, cut.collect()))
    assert 900 <= len(ranges) <= 1100 and sum(r[1] for r in ranges) == n and max(r[1] for r in ranges) <= 5 * 1000
    assert all(a[3] < b[2] for a, b in zip(ranges, ranges[1:]))


def test_pieces_beyond_the_borders(spark, monkeypatch):
    """With few borders ranges are cut further, ties stay together, null orders come first."""
    monkeypatch.setattr(O, "BORDERS", 8)
    rows = [("hot", t) for t in rnd.sample(range(10**15), 900)] + [("hot", None), (None, 3), (None, None)]
    df = spark.createDataFrame(rows, "k string, t bigint")
    first = lambda t: -1 if t is None else t
    want = {(k, t): sorted(first(x) for k2, x in rows if k2 == k).index(first(t)) + 1 for k, t in rows}
    got = O.number_rows(df, ["k"], "t", most=100).collect()
    assert {(r.k, r.t): r.n for r in got} == want and len(got) == len(rows)
    keyed = df.selectExpr("struct(k) as __key", "t")
    assert 20 < O.with_ranges(keyed, "t", O.hot_borders(keyed, "t", 100)).select("__key", "__range").distinct().count() < 45


def test_latency_carries_the_last_known_time(spark):
    rows = [(rnd.choice(KEYS), n, None if rnd.random() < 0.5 else n * 10 + rnd.randint(-30, 30)) for n in range(600)]
    rows += [("gap", 1, 5), ("gap", 400, None), ("gap", 900, 50), ("unknown", 1, None)]
    df = spark.createDataFrame(rows, "k string, n int, t int")
    want, last = {}, {}
    for k, n, t in sorted(rows, key=lambda r: r[1]):
        prev = last.get(k)
        want[(k, n)] = t - prev if t is not None and prev is not None and t >= prev else None
        last[k] = t if t is not None else prev
    got = {(r.k, r.n): r.ms for r in O.part_latency(df, ["k"], "n", "t", most=20).collect()}
    assert got == want


def test_latency_starts_at_the_request_time(spark):
    df = spark.createDataFrame([("r", 1, 1500, 1000), ("r", 2, None, 1000), ("r", 3, 2500, 1000)], "k string, n int, t int, t0 int")
    assert by(O.part_latency(df, ["k"], "n", "t", "t0"), "n", "ms") == {1: 500, 2: None, 3: 1000}


def test_first_result_in_time(spark):
    parts = [(i, rnd.choice(KEYS), rnd.randint(0, 3000)) for i in range(400)]
    results = [(i, rnd.choice(KEYS), rnd.randint(0, 3000)) for i in range(300)] + [(900, "edge", 100), (901, "edge", 125)]
    parts += [(900, "edge", 100), (901, "edge", 75), (902, "edge", 74), (903, "edge", 125), (904, "edge", 126)]
    wait, want = 25, {}
    for pid, k, at in parts:
        times = sorted((t, r) for r, k2, t in results if k2 == k)
        i = bisect.bisect_left(times, (at, -1))
        want[pid] = times[i] if i < len(times) and times[i][0] <= at + wait else (None, None)
    p = spark.createDataFrame(parts, "pid int, k string, at int")
    r = spark.createDataFrame(results, "result_id int, k string, at int")
    got = by(O.first_result_within(p, r, "k", "at", wait), "pid", "result_at", "result_id")
    assert got == want and len(got) == len(parts)


def test_sessions(spark):
    rows = [(rnd.choice(KEYS), rnd.randint(0, 60_000)) for _ in range(700)] + [("e", 0), ("e", 30), ("e", 61), ("e", 61)]
    want, gap = set(), 30
    for k in {k for k, _ in rows}:
        times = sorted(t for k2, t in rows if k2 == k)
        start = prev = times[0]
        n = 0
        for t in times + [10**9]:
            if t - prev > gap:
                want.add((k, start, prev + gap, n))
                start, n = t, 0
            prev, n = t, n + 1
    got = {tuple(r) for r in O.sessions(spark.createDataFrame(rows, "k string, at int"), "k", "at", gap).collect()}
    assert got == want
