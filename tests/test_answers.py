"""Answers: splitting, verdicts, redaction, and what may leave."""

import json

from pyspark.sql import functions as F

from parapet.functions import results as R
from parapet.operators import parts as P, verdicts as V
from tests.builders import DOCX, PNG, REDACTED, answer, file, result
from tests.conftest import by

CALL = {"functionCall": {"name": "f", "args": {}}}
THOUGHT = {"text": "secret reasoning 4111 1111", "thought": True}


def frame(spark, bodies):
    return spark.createDataFrame(list(bodies.items()), "id string, body string")


def test_split(spark):
    bodies = {
        "both": answer([{"text": "Here you go"}, file("image/png")]),
        "two images": answer([file("image/png")] * 2), "webp": answer([file("image/webp")]), "garbage": "nope",
        "thought": answer([THOUGHT, {"text": "Final"}, file("image/PNG")]),
        "calls": answer([CALL, {"text": "ok"}, {"fileData": {"fileUri": "x"}}, {"text": "  "}, {"text": "more"}]),
        "no bytes": answer([{"text": "x"}, {"inlineData": {"mimeType": "image/png"}}]), "empty": answer([]), "none": "{}",
    }
    got = by(P.split_answer(frame(spark, bodies), F.col("body")), "id", "shape_ok", "screen_text", "image_index", "kept_parts")
    assert got["both"] == (True, "Here you go", 1, 2) and got["thought"] == (True, "Final", 1, 2)
    assert [got[k][0] for k in ("two images", "webp", "garbage", "no bytes")] == [False] * 4
    assert got["calls"] == (True, "ok\nmore", None, 3)
    assert got["empty"] == got["none"] == (True, None, None, 0)


def test_strip(spark):
    clean = answer([{"text": "plain"}])
    bodies = {"clean": clean, "mixed": answer([CALL, {"text": "ok"}, THOUGHT, file("image/png")]), "only calls": answer([CALL, THOUGHT])}
    got = by(frame(spark, bodies).select("id", P.strip_unscreened(F.col("body")).alias("b")), "id", "b")
    assert got["clean"] == clean
    mixed = json.loads(got["mixed"])
    assert mixed["candidates"][0]["content"] == {"role": "model", "parts": [{"text": "ok"}, file("image/png")]}
    assert mixed["usageMetadata"] == {"totalTokenCount": 9} and "secret" not in got["mixed"]
    assert json.loads(got["only calls"])["candidates"][0]["content"]["parts"] == []


def test_swap(spark):
    rows = [("png", 1, REDACTED), ("jpeg", 1, "/9j/xx"), ("other", 1, "Qk0="), ("missing", 5, REDACTED), ("text", 0, REDACTED)]
    body = answer([{"text": "sign"}, file("image/bmp")])
    df = spark.createDataFrame(rows, "id string, i int, data string").withColumn("body", F.lit(body))
    got = by(df.select("id", P.swap_image(F.col("body"), F.col("i"), F.col("data")).alias("b")), "id", "b")
    inline = lambda k: json.loads(got[k])["candidates"][0]["content"]["parts"][1]["inlineData"]
    assert inline("png") == {"mimeType": "image/png", "data": REDACTED}
    assert inline("jpeg")["mimeType"] == "image/jpeg" and inline("other")["mimeType"] == "image/bmp"
    assert got["missing"] is None and got["text"] is None


def verdicts(spark, rows):
    """rows: id -> (action, image result or None, text result or None, shape ok)."""
    data = [(k, a, i, t, s) for k, (a, i, t, s) in rows.items()]
    df = spark.createDataFrame(data, "id string, action string, i string, t string, shape boolean")
    df = R.summarize(R.summarize(df, "i", prefix="i_"), "t", prefix="t_")
    of = lambda raw, col: F.when(F.col(raw).isNotNull(), F.col(col))
    state = V.image_state(of("i", "i_verdict"), F.col("i_filters"), F.col("i_redacted_image").isNotNull(), F.col("i_complete"), F.col("action"))
    df = df.withColumn("state", state)
    verdict = V.answer_verdict(F.col("shape"), of("t", "t_verdict"), of("i", "i_verdict"), F.col("state"))
    matched = V.answer_matched(of("t", "t_filters"), of("i", "i_filters"))
    return by(df.select("id", "state", verdict.alias("v"), matched.alias("m")), "id", "v", "state", "m")


def test_answer_verdicts(spark):
    sdp = result(["sdp"], redacted=REDACTED)
    skipped = result(["sdp"], skipped=["rai"], redacted=REDACTED)
    got = verdicts(spark, {
        "redact": ("redact", sdp, None, True),
        "injection in image": ("redact", result(["pi_and_jailbreak"], redacted=REDACTED), None, True),
        "sdp and more": ("redact", result(["sdp", "rai"], redacted=REDACTED), None, True),
        "no redacted image": ("redact", result(["sdp"]), None, True),
        "block": ("block", sdp, None, True),
        "clean": ("redact", result(redacted=REDACTED), None, True),
        "text leak": ("redact", None, result(["sdp"]), True),
        "image incomplete": ("redact", result(invocation="FAILURE", skipped=["all"], redacted=REDACTED), None, True),
        "bad shape": ("redact", None, None, False),
        "nothing": ("redact", None, None, True),
        "skipped filter": ("redact", skipped, None, True),
        "partial": ("redact", result(["sdp"], invocation="PARTIAL", redacted=REDACTED), None, True),
        "blocked wins": ("redact", skipped, result(["pi_and_jailbreak"]), True),
        "redactable but text incomplete": ("redact", sdp, result(skipped=["rai"]), True),
        "redactable but bad shape": ("redact", sdp, None, False),
    })
    assert {k: v[:2] for k, v in got.items()} == {
        "redact": ("redacted", "redacted"), "injection in image": ("blocked", "blocked"), "sdp and more": ("blocked", "blocked"),
        "no redacted image": ("blocked", "blocked"), "block": ("blocked", "blocked"), "clean": ("allowed", "clean"),
        "text leak": ("blocked", "none"), "image incomplete": ("incomplete", "clean"), "bad shape": ("incomplete", "none"),
        "nothing": ("allowed", "none"), "skipped filter": ("incomplete", "incomplete"), "partial": ("incomplete", "incomplete"),
        "blocked wins": ("blocked", "incomplete"), "redactable but text incomplete": ("incomplete", "redacted"),
        "redactable but bad shape": ("incomplete", "redacted"),
    }
    assert got["text leak"][2] == "text:sdp" and got["sdp and more"][2] == "image:rai:dangerous,image:sdp"


def test_record_holds_names_only(spark):
    df = spark.createDataFrame([(result(["sdp"], redacted=REDACTED),)], "i string")
    df = R.summarize(df, "i")
    image = F.struct("verdict", "filters", "findings")
    null = F.lit(None).cast("struct<verdict:string,filters:array<string>>")
    row = df.select(F.to_json(V.answer_record(F.lit("redacted"), null, image, F.lit("redacted"), F.lit("redact")))).first()[0]
    assert json.loads(row)["image"]["findings"] == ["PHONE_NUMBER", "EMAIL_ADDRESS"]
    assert "SECRET" not in row and REDACTED not in row


def test_display_text_and_usage(spark):
    bodies = {
        "a": answer([THOUGHT, {"text": "x"}, {"text": "y"}, file("image/png")]), "b": answer([{"inlineData": {"mimeType": "i"}}]),
        "c": "nope", "d": json.dumps({"choices": [{"message": {"content": "hey"}}]}), "e": json.dumps({"output": "o", "error": "x"}),
        "f": json.dumps({"error": {"message": "m"}}), "g": json.dumps({"error": "plain"}), "h": '{"z":1}', "i": '"quoted"', "j": None,
    }
    df = frame(spark, bodies)
    got = by(df.select("id", P.answer_text_and_image(F.col("body")).alias("s")), "id", "s")
    assert got["a"].text == "xy" and got["a"].image.dataBase64 == PNG and got["b"].image is None and got["c"].text == ""
    shown = by(df.select("id", P.fallback_text(F.col("body")).alias("t")), "id", "t")
    assert [shown[k] for k in "cdefghij"] == ["nope", "hey", "o", "m", "plain", '{"z":1}', "quoted", ""]
    usage = by(df.select("id", P.usage_tokens(F.col("body")).alias("u")), "id", "u")
    assert usage["a"].total == 9 and usage["a"].prompt is None and usage["c"].total is None


def test_untrusted_headers(spark):
    parts = json.dumps([{"n": 1, "filters": ["a" * 80, 3], "ms": "7", "verdict": "blocked"}, {"n": True}, {"n": "2"}, 5,
                        {"n": 3, "kind": "", "ms": True, "filters": "x"}])
    df = spark.createDataFrame([(parts, json.dumps({"verdict": "blocked", "text": 3, "image": {"filters": ["sdp", 1]}}))], "p string, a string")
    got, ans = df.select(P.clean_parts(F.col("p")), P.clean_answer(F.col("a"))).first()
    assert [(p.n, p.kind, p.verdict, p.filters, p.ms) for p in got] == [
        (1, "file", "blocked", ["a" * 60], 7), (3, "file", "", [], 0)]
    assert ans.text is None and ans.image.filters == ["sdp"] and ans.image.findings == []


def test_describe_keeps_content_out(spark):
    df = spark.createDataFrame([("file", "secret text", 12345)], "k string, t string, b bigint")
    d = df.select(P.describe_input(F.col("k"), F.length("t"), F.lit("a.pdf"), F.lit("application/pdf"), F.col("b"), F.col("t"), F.lit(None))).first()[0]
    assert d.body == "<base64, 16,460 chars>" and d.extracted_chars == 11 and d.truncated is False


def test_last_answer(spark):
    df = spark.createDataFrame([(answer([{"text": "a"}, {"text": "b"}]), "{}")], "x string, y string")
    schema = "candidates array<struct<content struct<parts array<struct<text string>>>>>".replace("content struct", "content: struct").replace("parts array", "parts: array").replace("text string", "text: string")
    parse = lambda c: F.from_json(c, schema).candidates
    assert tuple(df.select(P.last_answer_text(parse("x")), P.last_answer_text(parse("y"))).first()) == ("b", None)
    assert DOCX
