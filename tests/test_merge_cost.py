"""What a merge of a large log takes: one parse, no filters where they tell nothing, cheap labels."""

import random

from pyspark.sql import functions as F

from parapet.functions import scalars as X
from parapet.operators import ledger as L
from parapet.plans import arrivals
from parapet.sources import known, readers, writers
from tests.test_ledger import ledger, row

DATA = "/root/testdata/sf0.001"


def test_a_large_log_reads_all_buckets_without_the_filters(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    stored = [row(f"id-{i}", i % 50, f"req-{i}" if i % 3 else None, L.EXTERNAL if i % 2 else "ui") for i in range(600)]
    writers.append_ledger(ledger(spark, stored[:500]), path, "a")
    writers.append_ledger(ledger(spark, stored[500:]), path, "b")
    log = ledger(spark, [row(f"id-{i}", 1, f"req-{i + 300}", L.EXTERNAL) for i in range(0, 1200, 3)] + [row(None, 1, "q"), row("y", 1, None)])
    want = sorted(r.id for r in L.new_entries(log, readers.read_ledger(spark, path)).collect())
    few = sorted(r.id for r in readers.new_to_ledger(log, path).collect())

    def fail(*args):
        raise AssertionError("the filters were asked")

    monkeypatch.setattr(known, "candidate_buckets", fail)
    monkeypatch.setattr(known, "ASKED_AT_MOST", 100, raising=False)
    assert sorted(r.id for r in readers.new_to_ledger(log, path).collect()) == want == few and 100 < len(want) < 300
    assert readers.new_to_ledger(log, path + "-none").count() == log.where("id is not null").count()


def test_large_runs_have_filters_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known, "KEYS_PER_BITMAP", 2)
    monkeypatch.setattr(known, "BITMAPS_PER_FILE", 64, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = str(tmp_path / "ledger")
    writers.append_ledger(ledger(spark, [row(f"id-{i}", 1, None) for i in range(2000)]), path, "a")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    run = readers.live_runs(spark, path)[0]
    filters = spark.read.parquet(f"{path}/_filters/{run['folder']}")
    assert run["slices"] >= 64 and len(filters.inputFiles()) > 1
    assert filters.count() == filters.select("bucket", "slice").distinct().count()
    log = ledger(spark, [row(f"id-{i}", 1, None, L.EXTERNAL) for i in range(1990, 2010)])
    assert readers.new_to_ledger(log, path).count() == 10


def test_the_log_is_parsed_once(spark, monkeypatch):
    written, append = [], arrivals.append_ledger

    def noted(df, path, run):
        written.extend(df.inputFiles())
        append(df, path, run)

    monkeypatch.setattr(arrivals, "append_ledger", noted)
    rows = arrivals.ledger_merge(spark, DATA)
    assert rows.count() > 0 and written and not [f for f in written if f.endswith("events.parquet")]


def test_labels_equal_the_pattern(spark):
    pick = random.Random(3)
    texts = ["".join(pick.choices("aZ09_:,.- /<>\n\t\\]^é\U0001f600İ\0", k=pick.randrange(12))) for _ in range(500)] + ["x" * 200, "x<" * 200, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = F.left(F.regexp_replace(F.coalesce("t", F.lit("")), r"[^A-Za-z0-9_:,.\- ]+", ""), F.lit(64))
    assert df.where(X.clean_label(F.col("t"), 64) != pattern).count() == 0
    plan = df.select(X.clean_label(F.col("t"), 64))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
