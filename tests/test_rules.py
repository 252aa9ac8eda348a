"""Rules from a table: the same hits as trying every pattern on every text, without a cross join."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parapet import settings as S
from parapet.operators import rules as R

PARTS = {
    "worthless idiot": "worthless", r"(?i)\bAll\s+rights\s+reserved\b": "reserved", r"colou?rs": "colo", r"ab*cde": "cde", r"abc+def": "def",
    r"a|b": None, r"\d{3}-\d{2}": None, r"(foo)?barbaz": "barbaz", r"(needed)words": "words", r"[abc]xyz{2}w": None, r"\Qa.b (c) word\E": "word",
    r"(?x) a b c d": None, r"(?i)GB82WEST": "gb82west", r"x{3}yyy{0,2}zzz": "zzz", r"\x41bcd": None, r"((one)two(three(four)))five": "five",
    r"end\.example": "example", r"(?!never)ever": "ever", r"abc{2}": None, "é+word": "word", r"\\Qx": None, r"(?s)a.cde": None, r"[[]ab]cde": None,
}


def test_required_parts(spark):
    df = spark.createDataFrame([(p,) for p in PARTS], "pattern string")
    assert {r.pattern: r.part for r in df.select("pattern", R.required_part(F.col("pattern")).alias("part")).collect()} == PARTS


def plain(texts, rules):
    return Counter((i, r, f) for i, t in texts for r, f, p in rules if t is not None and re.search(p.replace(r"\Q", "").replace(r"\E", ""), t))


def test_hits_equal_every_pattern_on_every_text(spark):
    texts = [(1, "You are a WORTHLESS idiot"), (2, "worthless idiots, all"), (3, None), (4, ""), (5, "All  Rights\nReserved now"), (6, "my colors, 123-45"),
             (7, "unworthless idiotic colours"), (7, "worthless idiot"), (8, "x" * 300_000 + "colors"), (9, "barbaz abccdef abdef acde")]
    rules = [(i, f"f{i}", p) for i, p in enumerate([
        "worthless idiot", r"(?i)all\s+rights\s+reserved", r"colou?rs", r"\d{3}-\d{2}", r"(foo)?barbaz", r"abc+def", r"ab*cde", "a|b", r"(?i)\bworthless\b"])]
    df = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    table = spark.createDataFrame(rules, "rule_id int, filter string, pattern string")
    assert Counter(tuple(r) for r in R.match_rule_table(df, table).collect()) == plain(texts, rules)
    assert R.match_rule_table(df, table.limit(0)).count() == 0 and R.match_rule_table(df.limit(0), table).count() == 0


def test_ten_thousand_rules_without_a_cross_join(spark):
    texts = [(i, " ".join(f"word{(i * 37 + j) % 9000}x" for j in range(30))) for i in range(300)]
    table = spark.range(10_000).select(
        F.col("id").alias("rule_id"), F.lit("f").alias("filter"),
        F.concat(F.lit(r"(?i)\bWORD"), F.col("id"), F.lit(r"x\s+word"), (F.col("id") + 1).cast("string"), F.lit("x")).alias("pattern"))
    df = spark.createDataFrame(texts, "doc_id int, text string")
    found = R.match_rule_table(df, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(i, (i * 37 + j) % 9000) for i in range(300) for j in range(29) if (i * 37 + j) % 9000 != 8999}
    assert {(r.doc_id, r.rule_id) for r in found.collect()} == want


def test_too_many_rules_without_a_part(spark):
    table = spark.range(R.SCANNED + 1).select(F.col("id").alias("rule_id"), F.lit("f").alias("filter"), F.lit("a|b").alias("pattern"))
    with pytest.raises(ValueError):
        R.match_rule_table(spark.createDataFrame([(1, "a")], "doc_id int, text string"), table)


def test_the_fixed_rules_as_a_table(spark):
    texts = [(i, s[3]) for i, s in enumerate(S.SCENARIOS)] + [(9, "mail a@b.example or 078-05-1120")]
    rules = [(i, n, p) for i, (n, p) in enumerate([*S.PROMPT_RULES, *S.INFO_TYPES])]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {(r.doc_id, r.rule_id) for r in R.match_rule_table(df, spark.createDataFrame(rules, "rule_id int, filter string, pattern string")).collect()}
    want = set()
    for i, _, p in rules:
        want |= {(r.doc_id, i) for r in df.where(F.col("text").rlike(p)).collect()}
    assert got == want
