"""Plans: each text is screened once, and hot keys with sparse order values keep their results."""

import os
import random

import pytest
from pyspark.sql import functions as F

from parapet.operators import ordered
from parapet.plans import registry
from tests.conftest import by

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
@pytest.mark.parametrize("name, times", [
    ("screen_conversations", 1), ("part_records", 1), ("error_records", 1), ("forwarded_payload", 1), ("outcome_records", 2),
])
def test_patterns_run_once_per_role(spark, name, times):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    inputs = 3  # the table and two lists of seed rows, each with its own copy of the expression
    assert plan.count("worthless|idiot") == times * inputs


def test_sessions_of_a_hot_key_with_sparse_times(spark):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.7 else f"k{r.randrange(5)}", r.randrange(10**12) if r.random() < 0.3 else r.randrange(5_000)) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, at bigint").repartition(7)
    got = sorted(map(tuple, ordered.sessions(df, "k", "at", 40).collect()))
    want = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key)
        start = end = times[0]
        n = 0
        for t in [*times, None]:
            if t is None or t - end > 40:
                want.append((key, start, end + 40, n))
                start, n = t, 0
            end, n = t, n + 1
    assert got == sorted(want)


def test_first_result_of_a_busy_key(spark):
    r = random.Random(5)
    parts = [("hot" if i % 3 else "k", r.randrange(900), i) for i in range(400)]
    results = [("hot" if r.random() < 0.8 else "k", r.randrange(1200), i) for i in range(300)]
    p = spark.createDataFrame(parts, "k string, at bigint, part bigint").repartition(5)
    q = spark.createDataFrame(results, "k string, at bigint, result_id bigint").repartition(5)
    got = by(ordered.first_result_within(p, q, "k", "at", 25), "part", "result_at")
    for key, at, part in parts:
        assert got[part] == min((t for k, t, _ in results if k == key and at <= t <= at + 25), default=None)


def test_request_latency(spark):
    rows = [("a", 1, 110, 100), ("a", 2, None, 100), ("b", 1, None, 100), ("c", 1, 90, 100), ("d", 2, 130, 100), ("d", 1, 150, 100)]
    df = spark.createDataFrame(rows, "r string, n int, at int, start int")
    assert by(ordered.request_latency(df, ["r"], "n", "at", "start"), "r", "total_ms") == {"a": 10, "b": 0, "c": 0, "d": 30}
    assert df.select(F.count("*")).first()[0] == 6
