"""Folding parts, native mode, statuses, outcomes and comparisons."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from parapet import settings as S
from parapet.operators import compare as C, verdicts as V
from tests.conftest import by

A, B, I = S.ALLOWED, S.BLOCKED, S.INCOMPLETE


def fold(spark, parts, **kw):
    df = spark.createDataFrame(parts, "r string, n int, verdict string, filters array<string>")
    return by(V.fold_parts(df, ["r"], **kw), "r", "verdict", "matched", "n_parts")


def test_every_combination_of_verdicts(spark):
    rows, want = [], {}
    for size in range(1, 5):
        for combo in itertools.product([A, B, I, None], repeat=size):
            rid = ",".join(map(str, combo))
            rows += [(rid, i + 1, v, ["sdp"] if v == B else []) for i, v in enumerate(combo)]
            verdict = B if B in combo else A if set(combo) == {A} else I
            want[rid] = (verdict, ",".join(f"p{i + 1}:sdp" for i, v in enumerate(combo) if v == B) or "none", size)
    random.Random(1).shuffle(rows)
    assert fold(spark, rows) == want


def test_no_parts_and_too_many(spark):
    rows = [("zero", None, None, [])] + [("five", i, B, ["sdp"]) for i in range(1, 6)] + [
        ("order", 3, B, ["sdp", "rai:x"]), ("order", 1, B, ["pi_and_jailbreak"]), ("order", 2, A, ["ignored"])]
    got = fold(spark, rows)
    five = "p1:sdp,p2:sdp,p3:sdp,p4:sdp,p5:sdp"
    assert got == {"zero": (I, "none", 0), "five": (B, five, 5), "order": (B, "p1:pi_and_jailbreak,p3:sdp,p3:rai:x", 3)}
    many = [("many", i, B if i == 9 else A, ["sdp"] if i == 9 else []) for i in range(1, 12)] + [("clean", i, A, []) for i in range(1, 6)]
    df = spark.createDataFrame(many, "r string, n int, verdict string, filters array<string>")
    folded = V.fold_parts(df, ["r"]).withColumn("judged", V.request_verdict(F.col("verdict"), F.col("over_limit")))
    assert by(folded, "r", "verdict", "matched", "over_limit", "judged") == {
        "many": (B, "p9:sdp", True, B), "clean": (A, "none", True, S.ERROR)}


def test_unreported_request_is_incomplete(spark):
    requests = spark.createDataFrame([("a",), ("b",)], "r string")
    folded = spark.createDataFrame([("a", A, "none")], "r string, verdict string, matched string")
    assert by(V.verdict_for_requests(requests, folded, ["r"]), "r", "verdict", "matched") == {"a": (A, "none"), "b": (I, "none")}


def test_array_fold_agrees(spark):
    rows = [("a", []), ("b", [(1, A, []), (2, B, ["sdp"])]), ("c", [(1, A, []), (2, I, [])]), ("d", [(1, A, [])])]
    df = spark.createDataFrame(rows, "r string, p array<struct<n:int,verdict:string,filters:array<string>>>")
    got = by(df.select("r", V.fold_array(F.col("p")).alias("f")), "r", "f")
    assert {k: tuple(v) for k, v in got.items()} == {"a": (I, "none"), "b": (B, "p2:sdp"), "c": (I, "none"), "d": (A, "none")}


@pytest.mark.parametrize("verdict,files,flow,want", [
    (A, 0, "chat", A), (A, 2, "chat", S.UNSUPPORTED), (A, 0, "image", S.UNSUPPORTED), (B, 2, "chat", B), (I, 1, "image", I)])
def test_native_mode(spark, verdict, files, flow, want):
    df = spark.createDataFrame([(verdict, files, flow)], "v string, f int, w string")
    cols = (F.col("v"), F.col("f"), F.col("w"))
    got, why = df.select(V.native_prompt_verdict(*cols), V.unsupported_reason(*cols)).first()
    assert got == want and (why is not None) == (want == S.UNSUPPORTED)
    if files == 2 and why:
        assert "2 attachments could not" in why


def test_statuses(spark):
    rows = [(200, None), (204, None), (400, None), (403, None), (429, None), (401, None), (503, None), (400, "INVALID_ARGUMENT"),
            (400, "BLOCKED_BY_SCREENING")]
    df = spark.createDataFrame(rows, "s int, c string")
    got = df.select(V.status_verdict(F.col("s"), F.col("c")), V.multipart_status_verdict(F.col("s"), F.lit("redacted"), F.col("c")),
                    V.strict_status_verdict(F.col("s"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [
        (A, "redacted", A), (A, "error", A), (B, B, "error"), (B, "error", "error"), (B, "error", "error"),
        ("error", "error", "error"), ("error", I, "error"), ("error", "error", "error"), (B, B, B)]
    led = spark.createDataFrame([(v,) for v in (A, "redacted", B, I, "unsupported")], "v string").select(V.ledger_verdict(F.col("v")))
    assert [r[0] for r in led.collect()] == [A, A, B, "error", "error"]
    hits = spark.createDataFrame([({"sdp": "MATCH_FOUND", "rai": "NO_MATCH_FOUND"},)], "m map<string,string>")
    assert hits.select(V.matched_states(F.col("m"))).first()[0] == ["sdp"]


def test_outcome_triplets(spark):
    rows = [(A, A), (B, None), (I, None), (A, B), (A, None), ("unsupported", None), (A, "redacted")]
    df = spark.createDataFrame(rows, "p string, a string")
    df = df.withColumn("o", V.outcome(F.col("p"), F.col("a"))).withColumn("s", V.outcome_status(F.col("o.outcome")))
    got = [(r.o.outcome, r.o.prompt_verdict, r.o.answer_verdict, r.o.stage, r.s.http_status) for r in df.collect()]
    assert got == [
        (A, A, A, "response", 200), (B, B, "none", "prompt", 400), (I, I, "none", "prompt", 503), (B, A, B, "response", 400),
        (I, A, I, "response", 503), ("unsupported", "unsupported", "none", "prompt", 400), ("redacted", A, "redacted", "response", 200)]
    ok = df.select(C.verdict_triplet_ok(F.col("o"), (B, A, B))).collect()
    assert [r[0] for r in ok] == [False, False, False, True, False, False, False]


def test_explanations_and_chips(spark):
    rows = [(A, [], 200, "OK"), (B, ["rai:harassment", "sdp", "x"], 400, None), (S.ERROR, [], 400, "INVALID_ARGUMENT"), (B, [], 400, None),
            (S.ERROR, [], 503, None), (S.ERROR, [], 502, None)]
    df = spark.createDataFrame(rows, "v string, f array<string>, s int, c string")
    why = [r[0] for r in df.select(V.explain(F.col("v"), F.col("f"), F.col("s"), F.col("c"))).collect()]
    assert why[1] == "Blocked: Responsible AI (harassment), Sensitive data, x" and len(set(why)) == 6
    chips = [tuple(r) for r in df.select(*V.filter_chips(F.col("v"), F.col("f"))).collect()]
    assert chips[0] == ("pass",) * 4 and chips[1] == ("hit", "pass", "pass", "hit") and set(chips[3]) == {"unknown"}


def test_combined_modes(spark):
    rows = [(B, B), (A, A), ("error", None), (None, None), (A, B), (A, None)]
    df = spark.createDataFrame(rows, "n string, c string").select(V.combine_modes(F.col("n"), F.col("c")))
    assert [r[0] for r in df.collect()] == [B, A, "error", "error", "mixed", "mixed"]


def test_mode_comparison(spark):
    rows = [("x", "native", B, ["rai:a", "sdp"], 10), ("x", "callout", B, ["sdp", "rai:b"], 35), ("y", "native", B, ["sdp", "sdp"], 0),
            ("y", "callout", B, ["sdp"], 5), ("z", "native", A, [], 5)]
    df = spark.createDataFrame(rows, "id string, mode string, verdict string, filters array<string>, latency_ms int")
    got = by(C.compare_modes(df, ["id"]), "id", "same_verdict", "filters_differ", "combined", "latency_delta")
    assert got == {"x": (True, False, B, 25), "y": (True, True, B, None), "z": (False, False, "mixed", None)}


def test_scenarios_rules_and_counts(spark):
    rows = [("clean", A, []), ("sensitive-data", B, ["sdp"]), ("harmful-content", B, ["rai"]), ("malicious-url", B, ["sdp"]), ("other", A, [])]
    df = spark.createDataFrame(rows, "scenario_id string, verdict string, filters array<string>")
    got = by(C.scenario_check(df), "scenario_id", "passed")
    assert got == {"clean": True, "sensitive-data": True, "harmful-content": True, "malicious-url": False}
    assert tuple(C.count_table(df.withColumn("ok", F.col("verdict") == B), "ok").first()) == (3, 2, False)
    rules = [(i, f"r{i}", "a" if i % 2 else "b") for i in range(7)]
    texts = spark.createDataFrame([(1, "a"), (2, "ab"), (3, "c")], "id int, text string")
    hits = C.match_rules(texts, rules, keep=("id",))
    assert C.match_rules(texts, [], keep=("id",)).count() == 0
    assert hits.count() == 3 + 7 and hits.where("id = 1").count() == 3
