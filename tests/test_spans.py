"""Findings by position against a plain sweep: overlaps, order of the types, ends, many findings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import detect as D
from parapet.functions import spans as P

TYPES = [("LONG", r"\d+-\d+-\d+"), ("PAIR", r"\d+-\d+"), ("WORD", r"[a-z]+@[a-z]+"), ("AT", r"@[a-zé]+ \d"), ("TAIL", r"\d!+")]


def plain(text, types):
    found = sorted(((m.start(), -m.end(), name) for name, p in types for m in re.finditer(p, text or "")))
    groups = []
    for start, end, name in found:
        if groups and start < max(-e for _, e, _ in groups[-1]):
            groups[-1].append((start, end, name))
        else:
            groups.append([(start, end, name)])
    joined = [(g[0][0], max(-e for _, e, _ in g), min((s + e, s, n) for s, e, n in g)[2], len(g)) for g in groups]
    out, at = "", 0
    for start, end, name, _ in joined:
        out, at = out + text[at:start] + f"[{name}]", end
    return [(s, -e, n) for s, e, n in found], joined, None if text is None else out + text[at:]


def run(spark, texts, types):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("spans", P.finding_spans(F.col("text"), types))
    df = df.select("*", P.join_overlaps(F.col("spans")).alias("joined"), P.redact_spans(F.col("text"), types).alias("redacted"))
    return {r.id: ([tuple(s) for s in r.spans], [tuple(s) for s in r.joined], r.redacted) for r in df.collect()}


@pytest.mark.parametrize("order", [1, -1])
def test_overlaps_whatever_the_order_of_the_types(spark, order):
    r = random.Random(2)
    texts = ["".join(r.choice(["1", "23", "-", "-", "a", "b@c", "@é", " ", "!", "𝄞", "x"]) for _ in range(r.randrange(60))) for _ in range(200)]
    texts += ["", None, "none here", "1-2-3", "1-2-3!!", "é𝄞1-2 é@a 4-5-6-7!"]
    got = run(spark, texts, TYPES[::order])
    assert got == {i: plain(t, TYPES) for i, t in enumerate(texts)}


def test_rule_for_the_name(spark):
    (_, joined, redacted), = run(spark, ["call b@c 1-2-3!"], TYPES).values()
    assert joined == [(5, 15, "LONG", 5)] and redacted == "call [LONG]"


def test_many_findings_in_one_text(spark):
    text = " ".join(f"u{i}@host{i}.example and 555-12-{1000 + i % 9000}" for i in range(20_000))
    row = spark.createDataFrame([(text,)], "text string").select(
        P.join_overlaps(P.finding_spans(F.col("text"))).alias("joined"), P.redact_spans(F.col("text")).alias("redacted")).first()
    assert len(row.joined) == 40_000 and row.redacted == " ".join(["[EMAIL_ADDRESS] and [US_SOCIAL_SECURITY_NUMBER]"] * 20_000)
    assert all(text[s.start : s.end].startswith(("u", "555")) for s in row.joined[::997])


def test_same_findings_as_the_counts(spark):
    texts = ["Pay to GB82WEST12345698765432 or mail a.b@c.example, +1 (555) 123-4567", "card 4111 1111 1111 1111, 078-05-1120"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select(P.finding_spans(F.col("text")).alias("s"), D.type_counts(F.col("text")).alias("c")).collect():
        assert {c.info_type: c.n for c in r.c if c.n} == {t: sum(s.info_type == t for s in r.s) for t in {s.info_type for s in r.s}}
    assert [n for n, _ in S.INFO_TYPES][0] == "US_SOCIAL_SECURITY_NUMBER"
