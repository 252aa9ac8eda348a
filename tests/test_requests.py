"""Validation, splitting and forwarded payloads."""

import json

import pytest
from pyspark.sql import functions as F

from parapet import schemas
from parapet.operators import parts as P, validate as V
from tests.builders import DOCX, PDF, PNG, file, request
from tests.conftest import by

TEXT = {"text": "a"}


def single(spark, bodies, mode="native", **limits):
    df = spark.createDataFrame(list(bodies.items()), "id string, body string")
    return V.validate_single(V.parse_requests(df, "body"), F.lit(mode), **limits)


def multi(spark, bodies, **limits):
    df = spark.createDataFrame(list(bodies.items()), "id string, body string")
    return V.validate_multipart(V.parse_requests(df, "body"), **limits)


def test_text_requests(spark):
    bodies = {
        "ok": request([{"text": "hi there"}]), "no role": request([TEXT], role=None),
        "longest": request([{"text": "a" * 8000}]),
        "two contents": json.dumps({"contents": [{"role": "user", "parts": [TEXT]}] * 2}),
        "two parts": request([TEXT, TEXT]), "model role": request([TEXT], role="model"),
        "empty": request([{"text": "    "}]), "number": request([{"text": 42}]), "no json": "nope",
        "too long": request([{"text": "a" * 8001}]), "null text": request([{"text": None}]), "no contents": "{}",
        "array": "[1]", "both": request([{**TEXT, **file("application/pdf", PDF)}]), "null body": None,
    }
    got = by(single(spark, bodies), "id", "ok", "reason")
    assert {k for k, (ok, _) in got.items() if ok} == {"ok", "no role", "longest"}
    assert all((reason is None) == ok for ok, reason in got.values())


def test_file_requests(spark):
    bodies = {
        "pdf": request([file("application/PDF", PDF)]), "csv": request([file("text/csv", "YSxi")]),
        "png": request([file("image/png")]), "bad": request([file("application/pdf", "not base64!")]),
        "empty": request([file("application/pdf", "")]), "number": request([file("application/pdf", 7)]),
        "text+file": request([TEXT, file("application/pdf", PDF)]),
    }
    got = by(single(spark, bodies, "callout"), "id", "ok", "reason", "input")
    assert got["pdf"] == (True, None, "file:PDF") and got["csv"] == (True, None, "file:CSV")
    assert got["png"][1] == V.BAD_SINGLE_TYPE
    assert {got[k][1] for k in ("bad", "empty", "number")} == {V.BAD_BASE64}
    assert not got["text+file"][0]
    assert by(single(spark, {"pdf": bodies["pdf"]}), "id", "reason") == {"pdf": V.NEEDS_CALLOUT}
    large = by(single(spark, {"pdf": bodies["pdf"]}, "callout", max_file_b64=8), "id", "reason")
    assert large["pdf"].startswith("The file is longer")


MULTI = {
    "text": ([TEXT], True), "three files": ([TEXT] + [file("image/png")] * 3, True),
    "text last": ([file("image/png"), TEXT, file(DOCX)], True),
    "no text": ([file("image/png")], False), "two texts": ([TEXT, TEXT], False),
    "four files": ([TEXT] + [file("image/png")] * 4, False), "webp": ([TEXT, file("image/webp")], False),
    "bad base64": ([TEXT, file("image/png", "abc")], False), "blank": ([{"text": " "}, file("image/png")], False),
    "neither": ([TEXT, {}], False), "no parts": ([], False),
}


def test_multipart_requests(spark):
    got = by(multi(spark, {k: request(p) for k, (p, _) in MULTI.items()}), "id", "ok", "reason")
    assert {k: ok for k, (ok, _) in got.items()} == {k: ok for k, (_, ok) in MULTI.items()}
    assert got["no text"][1] == V.TEXT_REQUIRED and got["webp"][1] == "This file type is not accepted: image/webp."


def test_first_failure_wins(spark):
    bodies = {
        "size then type": request([TEXT, file("image/png", "AAAA" * 10), file("image/webp")]),
        "type then size": request([TEXT, file("image/webp"), file("image/png", "AAAA" * 10)]),
        "total": request([TEXT, file("image/png", "AAAA" * 4), file("image/png", "AAAA" * 4)]),
    }
    got = by(multi(spark, bodies, max_part=20, max_total=30), "id", "reason")
    assert got["size then type"] == V.PART_TOO_LARGE
    assert got["type then size"].startswith("This file type")
    assert got["total"].startswith("The files are longer")


def test_part_rows_agree_with_nested_requests(spark):
    rows = []
    for rid, (parts, _) in MULTI.items():
        for pos, p in enumerate(parts):
            inline = p.get("inlineData")
            kind = "text" if "text" in p else "file" if inline else "bad"
            rows.append((rid, pos, kind, p.get("text"), inline and inline["mimeType"], inline and inline["data"]))
    df = spark.createDataFrame(rows, "id string, pos int, kind string, text string, mime string, data string")
    facts = df.select("id", "pos", V.part_facts(*[F.col(c) for c in ("kind", "text", "mime", "data")]).alias("facts"))
    flat = by(V.validate_part_rows(facts, ["id"], "pos", "facts"), "id", "ok", "reason")
    nested = by(multi(spark, {k: request(p) for k, (p, _) in MULTI.items() if p}), "id", "ok", "reason")
    assert flat == nested


def test_split_numbers_text_first(spark):
    df = multi(spark, {"r": request([file("image/png"), TEXT, file(DOCX)])})
    rows = P.split_parts(df.where("ok"), ["id"]).orderBy("n").collect()
    assert [(r.n, r.kind, r.forwarded) for r in rows] == [(1, "text", True), (2, "IMAGE", True), (3, "WORD_DOCUMENT", False)]
    assert [r.bytes for r in rows] == [1, len(PNG) * 3 // 4, len(PNG) * 3 // 4]


def test_payloads_hold_only_what_was_screened(spark):
    extra = {"systemInstruction": {"parts": [{"text": "PWNED-7731"}]}, "tools": ["exfiltrate"]}
    df = multi(spark, {"r": request([file("text/csv", "YSxi"), TEXT, file(DOCX)], **extra)})
    payload = lambda mode, flow: json.loads(
        df.select(P.multipart_payload(F.col("parts"), F.lit(mode), F.lit(flow))).first()[0])
    both = payload("callout", "image")
    assert "PWNED" not in json.dumps(both) and "exfiltrate" not in json.dumps(both)
    parts = both["contents"][0]["parts"]
    assert parts[0] == TEXT and parts[1] == file("text/plain", "YSxi")
    assert "Word document passed screening" in parts[2]["text"]
    assert both["generationConfig"] == {"responseModalities": ["TEXT", "IMAGE"]}
    assert payload("native", "chat") == {"contents": [{"role": "user", "parts": [TEXT]}]}
    one = json.loads(df.select(P.file_payload(F.lit("text/csv"), F.lit("YSxi"), "Summarise.")).first()[0])
    assert one["contents"][0]["parts"] == [{"text": "Summarise."}, file("text/plain", "YSxi")]
    text = json.loads(df.select(P.text_payload(F.lit("hi"))).first()[0])
    assert text == {"contents": [{"role": "user", "parts": [{"text": "hi"}]}]}


def test_typed_requests(spark):
    row = [("r", [("user", [("hi", None), (None, ("image/PNG", PNG))])]), ("s", [("model", [("hi", None)])])]
    df = spark.createDataFrame(row, f"id string, contents {schemas.CONTENTS.simpleString()}")
    assert by(V.validate_multipart(V.shape_columns(df, "contents")), "id", "ok") == {"r": True, "s": False}
    last = df.select("id", P.last_part_text(F.col("contents")).alias("t"))
    assert by(last, "id", "t") == {"r": None, "s": "hi"}


@pytest.mark.parametrize("raw,native,callout", [
    (" CallOut ", "callout", "callout"), ("skip", "native", "callout"), (None, "native", "callout"), (" Native ", "native", "native"),
])
def test_modes(spark, raw, native, callout):
    df = spark.createDataFrame([(raw,)], "m string")
    row = df.select(V.normalize_mode(F.col("m")).alias("a"), V.normalize_mode(F.col("m"), "callout").alias("b")).first()
    assert (row.a, row.b) == (native, callout)


def test_routing(spark):
    df = spark.createDataFrame([("/generate-image", " Block "), ("/generate", "skip")], "p string, a string")
    flow = V.route_flow(F.col("p"))
    rows = df.select(flow.alias("flow"), V.normalize_action(F.col("a")).alias("a"), V.normalize_action(F.col("a"), "block").alias("b"),
                     V.route(flow, V.normalize_action(F.col("a")), "m", "im", "inspect", "redact").alias("r")).collect()
    assert [(r.flow, r.a, r.b, r.r.model, r.r.image_template) for r in rows] == [
        ("image", "block", "block", "im", "inspect"), ("chat", "redact", "block", "m", "redact")]


def test_uploads(spark):
    rows = [
        ("pdf", "a/b\\c.PDF", PDF), ("not pdf", "x.pdf", "aGVsbG8="), ("txt", "nöte?.txt", "aGVsbG8="), ("exe", "x.exe", PDF),
        ("no name", "", PDF), ("long name", "a" * 256, PDF), ("no data", "x.txt", ""), ("bad", "x.txt", "a b="),
        ("utf8", "x.txt", "//4="), ("large", "x.md", "QUFB" * 10), ("dot", ".txt", PDF),
    ]
    df = spark.createDataFrame(rows, "id string, filename string, data_base64 string")
    got = by(V.validate_upload(df, max_bytes=20), "id", "status", "safe_name", "kind", "bytes")
    assert got["pdf"] == (200, "c.PDF", "PDF", 13) and got["txt"] == (200, "n_te_.txt", "TXT", 5)
    assert {k for k, v in got.items() if v[0] == 200} == {"pdf", "txt"}
    assert got["large"][0] == 413 and got["large"][3] == 30


def test_attachments(spark):
    f = lambda name, data="QUFB": (name, data)
    rows = [
        ("ok", [f("a.png"), f("d/b.docx")]), ("none", None), ("four", [f("a.png")] * 4), ("type", [f("a.gif")]),
        ("null", [f("a.png", None)]), ("empty", [f("a.png", "")]), ("bad", [f("a.png", "A")]),
        ("large", [f("a.png", "QUFB" * 3)]), ("total", [f("a.png", "QUFB" * 2)] * 2),
    ]
    df = spark.createDataFrame(rows, "id string, files array<struct<name:string,dataBase64:string>>")
    got = by(V.validate_attachments(df, max_bytes=6, max_total=11), "id", "ok", "reason", "attachments")
    assert {k for k, v in got.items() if v[0]} == {"ok", "none"}
    assert [tuple(a) for a in got["ok"][2]] == [("a.png", "image/png", 3), ("b.docx", DOCX, 3)]
    assert got["large"][1].endswith("exceeds 4 MB.") and got["total"][1] == "The files exceed 5 MB together."


def test_prompts(spark):
    rows = [("clean", None), ("custom-1", "hello"), ("Bad Id", "x"), (None, " "), ("custom", "x" * 4001), ("clean", "mine")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, scenario_id string, prompt string")
    got = by(V.validate_prompt(df), "id", "prompt_ok", "prompt_scenario", "prompt_text")
    assert got[0][:2] == (True, "clean") and got[0][2].startswith("In two sentences")
    assert got[1] == (True, "custom", "hello") and got[5] == (True, "clean", "mine")
    assert [got[i][0] for i in (2, 3, 4)] == [False, False, False]


def test_native_prompt_is_never_cut(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x" * 8000), ("c", "")], "id string, text string")
    prompt = V.native_prompt(F.lit("n.txt"), F.col("text"))
    got = by(df.select("id", prompt.alias("p"), V.native_skip(F.col("text"), prompt).alias("skip")), "id", "p", "skip")
    assert got["a"][0].endswith("\n\n--- Document: n.txt ---\nx") and got["a"][1] is None
    assert "go unchecked" in got["b"][1] and got["c"][1].startswith("The file holds no text")
