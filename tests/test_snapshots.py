"""Ledger commits: readers, crashes and other writers at every step; lookups that open few buckets."""

import os

import pytest

from parapet.operators import ledger as L
from parapet.sources import known, readers, snapshots, writers
from tests.test_ledger import ledger, row


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "ledger")


def ids(spark, path):
    return sorted(r.id for r in readers.read_ledger(spark, path).collect())


def test_an_append_during_a_compaction(spark, path, monkeypatch):
    writers.append_ledger(ledger(spark, [row("a", 1), row("b", 2)]), path, "s-0")
    writers.append_ledger(ledger(spark, [row("c", 3)]), path, "s-1")
    write, done = writers._written, []

    def and_meanwhile(spark, df, path, name):
        run = write(spark, df, path, name)
        if name.startswith("kept") and not done:
            done.append(name)
            writers.append_ledger(ledger(spark, [row("d", 4)]), path, "s-2")
        return run

    monkeypatch.setattr(writers, "_written", and_meanwhile)
    writers.compact_ledger(spark, path, keep=None)
    assert done and ids(spark, path) == ["a", "b", "c", "d"]
    assert len(readers.live_runs(spark, path)) == 2


def test_a_run_replaced_during_a_compaction(spark, path, monkeypatch):
    writers.append_ledger(ledger(spark, [row("old", 1)]), path, "x")
    writers.append_ledger(ledger(spark, [row("b", 2)]), path, "y")
    write, done = writers._written, []

    def and_meanwhile(spark, df, path, name):
        run = write(spark, df, path, name)
        if name.startswith("kept") and not done:
            done.append(name)
            writers.append_ledger(ledger(spark, [row("new", 1)]), path, "x")
        return run

    monkeypatch.setattr(writers, "_written", and_meanwhile)
    writers.compact_ledger(spark, path, keep=None)
    assert ids(spark, path) == ["b", "new"] and len(readers.live_runs(spark, path)) == 1


def test_readers_keep_their_snapshot(spark, path):
    writers.append_ledger(ledger(spark, [row("a", 1), row("b", 2)]), path, "one")
    before = readers.read_ledger(spark, path)
    writers.append_ledger(ledger(spark, [row("c", 3)]), path, "one")
    writers.compact_ledger(spark, path)
    assert sorted(r.id for r in before.collect()) == ["a", "b"] and ids(spark, path) == ["c"]


def test_a_compacted_batch_is_not_added_again(spark, path):
    for i in range(3):
        writers.append_ledger(ledger(spark, [row(f"r{i}", i)]), path, f"stream-{i}")
    writers.append_ledger(ledger(spark, [row("named", 9)]), path, "named")
    writers.compact_ledger(spark, path, keep=3)
    for name in ("stream-2", "stream-1", "named"):
        writers.append_ledger(ledger(spark, [row("again", 1)]), path, name)
    assert ids(spark, path) == ["named", "r1", "r2"]
    writers.append_ledger(ledger(spark, [row("next", 1)]), path, "stream-3")
    assert ids(spark, path) == ["named", "next", "r1", "r2"]


class Crash(Exception):
    pass


STEPS = [(known, "write_keys", False), (snapshots.Folder, "write", False), (snapshots.Folder, "rename_new", False), (snapshots, "commit", True)]


@pytest.mark.parametrize("action", ["append", "replace", "compact"])
@pytest.mark.parametrize("where, step, after", STEPS)
def test_a_crash_at_every_step_leaves_the_old_or_the_new_state(spark, path, monkeypatch, action, where, step, after):
    writers.append_ledger(ledger(spark, [row("a", 1), row("b", 2)]), path, "one")
    writers.append_ledger(ledger(spark, [row("c", 3)]), path, "two")
    act = {
        "append": lambda: writers.append_ledger(ledger(spark, [row("d", 4)]), path, "three"),
        "replace": lambda: writers.append_ledger(ledger(spark, [row("e", 4)]), path, "one"),
        "compact": lambda: writers.compact_ledger(spark, path, keep=2),
    }[action]
    old, new = ["a", "b", "c"], {"append": ["a", "b", "c", "d"], "replace": ["c", "e"], "compact": ["b", "c"]}[action]
    real = getattr(where, step)

    def crash(*args, **kwargs):
        if after:
            real(*args, **kwargs)
        raise Crash

    with monkeypatch.context() as patched:
        patched.setattr(where, step, crash)
        with pytest.raises(Crash):
            act()
    assert ids(spark, path) == (new if after else old)
    act()  # the retry
    assert ids(spark, path) == new
    writers.vacuum_ledger(spark, path, 0)
    assert ids(spark, path) == new and len([p for p in os.listdir(path) if p.startswith("run=")]) == len(readers.live_runs(spark, path))
    assert len(os.listdir(f"{path}/_lists")) <= 2 and sorted(os.listdir(f"{path}/_keys")) == sorted(os.listdir(f"{path}/_filters"))


def test_the_second_of_two_writers_sees_the_first(spark, path):
    folder = snapshots.Folder(spark, path)
    run = lambda n: {"name": n, "folder": f"run={n}", "slices": 1}
    calls = []

    def slow(state):
        calls.append(len(state["runs"]))
        if len(calls) == 1:
            snapshots.commit(folder, snapshots.with_run(run("first")))
        return snapshots.with_run(run("second"))(state)

    assert snapshots.commit(folder, slow) == 2 and calls == [0, 1]
    assert [r["name"] for r in snapshots.load(folder)[1]["runs"]] == ["first", "second"]


def test_lookups_open_only_buckets_that_may_know(spark, path):
    stored = [row(f"id-{i}", i % 50, f"req-{i}", L.EXTERNAL if i % 2 else "ui") for i in range(4000)]
    writers.append_ledger(ledger(spark, stored[:3000]), path, "a")
    writers.append_ledger(ledger(spark, stored[3000:]), path, "b")
    runs = readers.live_runs(spark, path)
    some = [row("id-7", 1, None, L.EXTERNAL), row("fresh", 1, "req-3500", L.EXTERNAL)]
    asked = known.keys_of(ledger(spark, some).selectExpr("id", "request_id", "'asked' as source"))
    files = {f.split("/_keys/")[1].rsplit("/", 1)[0] for f in known.known_keys(spark, path, runs, asked).inputFiles()}
    assert files == {f"{r}/bucket={b}" for r, b in known.candidate_buckets(spark, path, runs, asked)}
    assert 2 <= len(files) <= 4 < len(runs) * known.BUCKETS
    fresh = known.keys_of(ledger(spark, [row(f"new-{i}", 1, f"nreq-{i}") for i in range(40)]))
    assert len(known.candidate_buckets(spark, path, runs, fresh)) <= 3


def test_lookups_equal_the_whole_merge(spark, path, monkeypatch):
    monkeypatch.setattr(known, "KEYS_PER_BITMAP", 20)
    stored = [row(f"id-{i}", i % 50, f"req-{i}" if i % 3 else None, L.EXTERNAL if i % 2 else "ui") for i in range(1500)]
    writers.append_ledger(ledger(spark, stored[:1400]), path, "a b%c=d")
    writers.append_ledger(ledger(spark, stored[1400:]), path, "e-1")
    assert len({r["slices"] for r in readers.live_runs(spark, path)}) == 2
    log = ledger(spark, [row(i, 1, q, L.EXTERNAL) for i, q in [
        *[(f"id-{i}", None) for i in range(0, 3000, 70)], *[(f"x-{i}", f"req-{i}") for i in range(0, 3000, 11)], (None, "q"), ("", "q"), ("y", None), ("z", "")]])
    want = sorted(r.id for r in L.new_entries(log, readers.read_ledger(spark, path)).collect())
    assert sorted(r.id for r in readers.new_to_ledger(log, path).collect()) == want and 100 < len(want) < 290
    assert readers.new_to_ledger(log, path + "-none").count() == L.new_entries(log, ledger(spark, [])).count()
