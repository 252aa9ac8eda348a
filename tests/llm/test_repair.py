"""Repaired conversations against a plain search over all edits: odd rows, ties, copies and a conversation over several partitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from parapet.llm import repair
from tests.llm.test_operators import prose

SHAPE = "conv_id bigint, turn bigint, role string, text string, kind string, conv string, __at string"
BLANK = re.compile("[\x20\x09-\x0d]*")


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare.lstrip(" \t\n\x0b\x0c\r") else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """The least (cost, audit, repaired) by states, one edit at a time."""
    def insertions(best):
        for _ in range(3):
            for s, (c, a, r) in list(best.items()):
                t, name = (3, "assistant:") if s == 2 else (2, "user:")
                best[t] = min(best.get(t, (10**9,)), (c + 2, a + "I", [*r, name]))
        return best

    best = insertions({0: (0, "", [])})
    for (role, text), fault in zip(rows, faults):
        grown = {}
        offer = lambda t, c, a, r: grown.__setitem__(t, min(grown.get(t, (10**9,)), (c, a, r)))
        for s, (c, a, r) in best.items():
            offer(s, c + 3, a + "D", r)
            if fault in ("blank", "duplicate"):
                continue
            c += fault == "truncated"
            if s == 0 and role[:1] == "s":
                offer(1, c, a + "K", [*r, f"{role}:{text}"])
            t, name = (3, "assistant") if s == 2 else (2, "user")
            if role[:1] == name[0]:
                offer(t, c, a + "K", [*r, f"{role}:{text}"])
            else:
                offer(t, c + 2, a + "R", [*r, f"{name}:{text}"])
        best = insertions(grown)
    return min(best[s] for s in (0, 3) if s in best)


def plain(turns):
    out, by_conv = {}, defaultdict(list)
    for c, t, role, text, *_ in turns:
        by_conv[c].append((t is not None, t or 0, " " if role is None else role, " " if text is None else text))
    for c, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        known, pairs = [t for has, t, *_ in rows if has], [(role, text) for *_, role, text in rows]
        faults = plain_faults(pairs)
        cost, audit, fixed = plain_repair(pairs, faults)
        letters = [role[:1] for role, _ in pairs]
        out[c] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit, fixed,
        )
    return out


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, list(r.repaired)) for r in df.collect()}


def random_turns(r, conv, n):
    texts = ["", " \t", "Fine.", "Well?", "cut off", "Good!", None, "ends here.\n"]
    return [
        (conv, r.choice([i, i, i, None, i + 3]), r.choice(["user", "assistant", "assistant", "user", "system", "tool", None, ""]),
         r.choice([r.choice(texts), f"{r.randrange(50)}.", f"{i} words and more"]), "x", "y", "z")
        for i in range(n)
    ]


def test_short_sequences_of_every_kind():
    """All kinds of up to three rows: the least audit of the tree against every string of edits."""
    for n in (1, 2, 3):
        for kinds in product(range(repair.FORCED + 1), repeat=n):
            levels = repair.tree(repair.row_tables()[np.array(kinds)], np.zeros(n, dtype=np.int64))
            ends = levels[-1][0][0, 0] // repair.STATES
            tails = {0: "", 1: "II", 2: "I", 3: ""}
            ways = []
            for t, tail in tails.items():
                if ends[t] < repair.FAR:
                    before, after = repair.descend(levels, np.array([0]), np.array([t]))
                    steps = [repair.row_edits(k)[s, e] for k, s, e in zip(kinds, before.tolist(), after.tolist())]
                    assert sum(x[0] for x in steps) == ends[t]
                    ways.append((ends[t] + 2 * len(tail), "".join(x[1] for x in steps) + tail))
            rows = [({0: "s", 1: "u", 2: "a", 3: "x"}[k % 8 // 2], "") for k in kinds]
            faults = ["blank" if k == repair.FORCED else "truncated" if k % 2 else "" for k in kinds]
            assert min(ways) == plain_repair(rows, faults)[:2]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, spread, seed):
    r = random.Random(seed)
    turns = [t for c in [None, *range(60)] for t in random_turns(r, c, r.randrange(1, 12))]
    assert found(repair.repair(spread(spark.createDataFrame(turns, SHAPE)))) == plain(turns)


def test_a_conversation_over_several_partitions(spark, spread):
    r = random.Random(3)
    turns = random_turns(r, 7, 3000) + [(7, 5000, "user", "again and again", "", "", "")] * 500
    turns += [(8, i, "user" if i % 2 else "assistant", prose(4, i) + ".", "", "", "") for i in range(900)] + random_turns(r, 9, 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spread(spark.createDataFrame(turns, SHAPE))
        rows = repair.sorted_rows(df)
        assert rows.where("conv = '7'").select("__part").distinct().count() > 1
        assert rows.where("conv = '7' and turn = 5000").count() == 1
        assert found(repair.repair(df)) == plain(turns)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_long_texts_and_empty_table(spark):
    turns = [(1, 0, "user", "a" * 1_000_000, "", "", ""), (1, 1, "assistant", "b. " * 300_000, "", "", "")]
    assert found(repair.repair(spark.createDataFrame(turns, SHAPE))) == plain(turns)
    empty = spark.createDataFrame([], SHAPE)
    assert repair.repair(empty).count() == 0 and repair.digest(empty).count() == 0


def test_damage_and_digest(spark, spread):
    r = random.Random(5)
    turns = [t for c in range(80) for t in random_turns(r, c, r.randrange(1, 5))] + [(None, None, None, None, "", "", "")] * 2
    hurt = []
    for c, t, role, text, *_ in turns:
        role, text = (" " if x is None else x for x in (role, text))
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        hurt += [] if f == 0 else [(c, t, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    want = plain(hurt)
    got = {x.conv_id: tuple(x)[1:] for x in repair.digest(spread(spark.createDataFrame(turns, SHAPE))).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert Counter(got) == Counter({
        c: (*want[c][:7], hashlib.sha256("\n".join(want[c][7]).encode()).hexdigest()) if c in want else none for c in {t[0] for t in turns}
    })
    assert len(want) < len(got)
    # an added column named like one of the operator's own changes nothing
    again = spark.createDataFrame(turns, SHAPE).withColumn("cost", F.lit(1))
    assert {x.conv_id: tuple(x)[1:] for x in repair.digest(again).collect()} == got
