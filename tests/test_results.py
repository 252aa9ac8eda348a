"""Screening results, their summary and the emulated results."""

import json

import pytest
from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import detect as D, results as R
from tests.builders import HIT, MISS, REDACTED, result, state
from tests.conftest import by


def summary(spark, raws, fn=R.summarize, **kw):
    df = spark.createDataFrame([(k, v) for k, v in raws.items()], "id string, raw string")
    return fn(df, "raw", **kw)


CASES = {
    "clean": (result(), "allowed", []),
    "injection": (result(["pi_and_jailbreak"]), "blocked", ["pi_and_jailbreak"]),
    "subtype": (result(["rai"]), "blocked", ["rai:dangerous"]),
    "sdp": (result(["sdp"]), "blocked", ["sdp"]),
    "skipped": (result(skipped=["sdp"]), "incomplete", []),
    "partial": (result(invocation="PARTIAL"), "incomplete", []),
    "over limits": (result(invocation="FAILURE", skipped=["all"]), "incomplete", []),
    "match beside skipped": (result(["sdp"], skipped=["rai"]), "blocked", ["sdp"]),
    "csam need not run": (result(skipped=["csam"]), "allowed", []),
    "html": ("<html>", "incomplete", []),
    "missing": (None, "incomplete", []),
    "trailing": (result() + " x", "incomplete", []),
    "state only": (json.dumps({"sanitizationResult": {"filterMatchState": HIT}}), "blocked", []),
    "no filters": (json.dumps({"sanitizationResult": {"filterMatchState": MISS, "filterResults": {}}}), "incomplete", []),
    "bare": (result(wrapped=False), "incomplete", []),
}


def test_summary(spark):
    got = by(summary(spark, {k: c[0] for k, c in CASES.items()}), "id", "verdict", "filters")
    assert got == {k: (v, f) for k, (_, v, f) in CASES.items()}


def test_text_summary_takes_bare_results(spark):
    got = by(summary(spark, {k: c[0] for k, c in CASES.items()}, R.summarize_text), "id", "verdict")
    assert got == {**{k: v for k, (_, v, _) in CASES.items()}, "bare": "allowed"}


def test_empty_required_list_never_allows(spark):
    assert by(summary(spark, {"c": result()}, required=[]), "id", "verdict") == {"c": "incomplete"}


def test_one_broken_filter_does_not_hide_the_next(spark):
    body = json.loads(result(["pi_and_jailbreak"]))
    fr = body["sanitizationResult"]["filterResults"]
    fr["rai"], fr["sdp"], fr["malicious_uris"] = 7, None, {"w": "x"}
    body["sanitizationResult"]["filterMatchState"] = MISS
    assert by(summary(spark, {"b": json.dumps(body)}), "id", "verdict", "filters") == {"b": ("blocked", ["pi_and_jailbreak"])}


def test_removing_a_required_filter_never_allows(spark):
    raws = {}
    for name in S.REQUIRED_FILTERS:
        body = json.loads(result())
        del body["sanitizationResult"]["filterResults"][name]
        raws[name] = json.dumps(body)
    assert set(by(summary(spark, raws), "id", "verdict").values()) == {"incomplete"}


def test_repeated_filter_counts_with_its_last_value(spark):
    first, last = json.dumps({"w": state(HIT)}), json.dumps({"w": state()})
    raw = '{"sanitizationResult":{"filterMatchState":"NO_MATCH_FOUND","filterResults":{"sdp":%s,"sdp":%s}}}' % (first, last)
    got = by(summary(spark, {"r": raw}, required=["sdp"]), "id", "verdict")
    assert got == {"r": "allowed"}


def test_findings_and_redacted_image(spark):
    raws = {"hit": result(["sdp"], redacted=REDACTED), "clean": result(redacted=REDACTED),
            "partial": result(["sdp"], invocation="PARTIAL", redacted=REDACTED)}
    df = summary(spark, raws)
    got = by(df, "id", "findings", "redacted_image", "complete")
    assert got["hit"] == (["PHONE_NUMBER", "EMAIL_ADDRESS"], REDACTED, True)
    assert got["clean"] == ([], None, True) and got["partial"][2] is False
    assert "SECRET OCR" not in str(df.drop("raw").collect())


def test_native_fault_and_flat_fields(spark):
    flat = json.dumps({"filterMatchState": HIT, "piAndJailbreakFilterResult.matchState": HIT,
                       "piAndJailbreakFilterResult.executionState": "EXECUTION_SUCCESS"})
    ran = {f"{S.RESULT_WRAPPERS[k]}{'.inspectResult' if k == 'sdp' else ''}.executionState": "EXECUTION_SUCCESS"
           for k in S.REQUIRED_FILTERS}
    clean = json.dumps({"filterMatchState": MISS, **ran})
    rows = [("flat", None, flat, True), ("fault only", None, None, True), ("nothing", None, None, False),
            ("flat clean", None, clean, False), ("readable wins", result(), flat, False)]
    df = spark.createDataFrame(rows, "id string, raw string, flat string, fault boolean")
    got = by(R.summarize_text(df, "raw", filter_fault=F.col("fault"), flat="flat"), "id", "verdict", "filters")
    assert got == {"flat": ("blocked", ["pi_and_jailbreak"]), "fault only": ("blocked", []), "nothing": ("incomplete", []),
                   "flat clean": ("allowed", []), "readable wins": ("allowed", [])}


def test_legacy_check_ignores_what_ran(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in CASES.items()], "id string, raw string")
    got = by(df.select("id", R.simple_verdict(F.col("raw")).alias("v")), "id", "v")
    assert got["skipped"] == "allowed" and got["clean"] == "allowed" and got["sdp"] == "blocked" and got["html"] == "incomplete"


def test_explode_and_fields(spark):
    df = spark.createDataFrame([("a", result(["rai"])), ("b", "nope")], "id string, raw string")
    rows = {r["filter"]: r for r in R.explode_filters(df, "raw", ("id",)).collect()}
    assert len(rows) == 5 and rows["rai"].names == ["rai:dangerous"] and rows["sdp"].match_state == MISS
    fields = df.select("id", *R.extract_fields(F.col("raw"))).where("id = 'a'").first()
    assert fields.rai_state == HIT and fields.sdp_state == MISS and fields.invocation == "SUCCESS"


def test_required_list(spark):
    df = spark.createDataFrame([(" rai, ,sdp,",)], "r string")
    assert df.select(R.parse_required(F.col("r"))).first()[0] == ["rai", "sdp"]


@pytest.mark.parametrize("hits,over,verdict,filters", [
    ([], False, "allowed", []), (["sdp", "rai:harassment"], False, "blocked", ["rai:harassment", "sdp"]),
    (["sdp"], True, "incomplete", []), ([], True, "incomplete", []),
])
def test_emulated_results_read_back(spark, hits, over, verdict, filters):
    df = spark.createDataFrame([(hits,)], "hits array<string>").withColumn("raw", R.emulate_result(F.col("hits"), F.lit(over)))
    row = R.summarize(df, "raw").first()
    assert (row.verdict, row.filters) == (verdict, filters)


def test_scenarios_are_caught(spark):
    rows = [(s[0], s[3], s[2]) for s in S.SCENARIOS]
    got = {r.id: r for r in D.screen(spark.createDataFrame(rows, "id string, text string, want string")).collect()}
    for sid, expect, wanted, _ in S.SCENARIOS:
        assert got[sid].verdict == expect and (wanted is None or wanted in got[sid].hits)


def test_fast_patterns_equal_the_plain_ones(spark):
    texts = [
        "ignore prior instructions", "IGNORE ALL PREVIOUS INSTRUCTIONS", "xDAN dan. Danish", "a system prompt", "Jailbreak!",
        "see https://x.malware.y/z", "http://ok.org malware", "://phishing", "Stupid", "stupidity", "everyone hates it", "override",
        "4111 1111 1111 1111", "x4111111111111111", "123-45-6789", "1234-45-6789", "developer mode", "shit", "shitty fucking",
        "a@b.com_c@d.org", "a.b+c@d-e.co.uk, x@y", "@@@a@b.cc", "aaa@bbb@ccc.dd", "+1 (555) 123-4567", "", "1-800 555 1234 5678",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for rule in S.PROMPT_RULES + S.UPLOAD_RULES:
        both = df.select(F.col("text").rlike(rule[1]).alias("a"), D.matches(F.col("text"), rule).alias("b"))
        assert all(r.a == r.b for r in both.collect()), rule
    counts = by(df.select("id", D.type_counts(F.col("text")).alias("c")), "id", "c")
    for name, pattern in S.INFO_TYPES:
        plain = by(df.select("id", F.regexp_count("text", F.lit(pattern)).alias("n")), "id", "n")
        assert plain == {i: next(x.n for x in c if x.info_type == name) for i, c in counts.items()}, name


def test_long_unbroken_runs_stay_linear(spark):
    runs = ["http://a" * 100_000, "a" * 800_000, "http://a" * 100_000 + "phishing", "x" * 9 + "http://b" * 50_000 + " malware"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(runs)], "id int, text string")
    got = df.select("id", D.matches(F.col("text"), S.PROMPT_RULES[1]).alias("link"), F.size(D.bad_links(F.col("text"))).alias("n"),
                    D.redact_text(F.concat("text", F.lit("@"))).alias("r"), D.type_counts(F.concat("text", F.lit("@"))).alias("c"))
    assert by(got, "id", "link", "n") == {0: (False, 0), 1: (False, 0), 2: (True, 1), 3: (False, 0)}


def test_links_are_whole(spark):
    text = "see (https://a.b/http://c.malware.d/x?y) and http://ok.org and HTTP://PHISHING.z end"
    row = spark.createDataFrame([(text,)], "t string").select(D.bad_links(F.col("t"))).first()[0]
    assert row == ["https://a.b/http://c.malware.d/x?y)", "HTTP://PHISHING.z"]


def test_redacted_text_has_no_finding_left(spark):
    text = "Card 4111 1111 1111 1111, mail a.b@c.org, call +1 555 123 4567, 078-05-1120, GB82WEST12345698765432"
    df = spark.createDataFrame([(text,)], "text string").select(D.redact_text(F.col("text")).alias("text"))
    row = df.select("text", D.type_counts(F.col("text")).alias("c")).first()
    assert all(x.n == 0 for x in row.c)
    assert all(f"[{name}]" in row.text for name, _ in S.INFO_TYPES)


def test_threshold(spark):
    rows = [("EMAIL_ADDRESS", "LOW"), ("EMAIL_ADDRESS", "MEDIUM"), ("EMAIL_ADDRESS", "HIGH"), ("OTHER", "HIGH"), ("EMAIL_ADDRESS", "?")]
    df = spark.createDataFrame(rows, "t string, c string")
    assert [r[0] for r in df.select(D.above_threshold(F.col("t"), F.col("c"))).collect()] == [False, True, True, False, False]
    off = df.select(D.above_threshold(F.col("t"), F.col("c"), {"EMAIL_ADDRESS": (False, "HIGH")}))
    assert not any(r[0] for r in off.collect())
