"""Queries over records: what callers, logs and the ledger are told about requests and answers."""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import detect as D, results as R, scalars as X
from parapet.operators import ledger as L, ordered, parts as P, validate, verdicts as V
from parapet.plans.common import TURNS_SQL, conversations, docs_sql, documents, filters_sql, or_minus_one, query, quote, screened_sql
from parapet.sources.readers import read_table, spread

_KINDS = ["PDF", "IMAGE", "CSV"]
_KIND_SQL = "CASE i " + " ".join(f"WHEN {i} THEN {quote(k)}" for i, k in enumerate(_KINDS)) + " END"


@query(f"""
WITH {docs_sql()}, s AS (SELECT * FROM {screened_sql('docs', 'doc_id, n_chars')}),
p AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS n, 'text' AS kind, verdict, filters, n_chars FROM s
  UNION ALL
  SELECT doc_id, i + 2, {_KIND_SQL}, 'unsupported', 'none', n_chars FROM s JOIN range({len(_KINDS)}) AS r(i) ON i < n_chars % 4)
SELECT doc_id, n, kind, verdict, filters, n = 1 AND verdict = 'allowed' AND n_chars % 4 = 0 AS forwarded FROM p
""")
def native_parts(spark, folder):
    """Part rows of text-only mode: the prompt is screened, every attachment is unsupported."""
    docs = D.screen(documents(spark, folder, columns=("text", "n_chars")))
    kinds = F.slice(F.array(*[F.lit(k) for k in _KINDS]), 1, (F.col("n_chars") % 4).cast("int"))
    return docs.select("doc_id", F.inline(V.native_part_records(F.col("verdict"), F.col("hits"), kinds))).select(
        "doc_id", "n", "kind", "verdict", D.names_or_none(F.col("filters")).alias("filters"), "forwarded"
    )


@query("""
WITH m AS (
  SELECT doc_id // 4 AS request_id, doc_id % 4 + 1 AS n, 1000 AS start,
         CASE WHEN n_chars % 5 <> 0 THEN 1000 + (doc_id % 4 + 1) * 300 - n_chars % 700 END AS mark FROM documents),
last AS (SELECT request_id, arg_max(mark, n) FILTER (mark IS NOT NULL) AS mark, max(start) AS start FROM m GROUP BY request_id)
SELECT request_id, CAST(greatest(0, coalesce(mark - start, 0)) AS BIGINT) AS total_ms FROM last
""")
def request_latency(spark, folder):
    """Total check time of a request of four documents: last known mark minus the start."""
    docs = read_table(spark, folder, "documents").select("doc_id", "n_chars")
    n = F.col("doc_id") % 4 + 1
    marks = docs.select(
        F.floor(F.col("doc_id") / 4).alias("request_id"), n.alias("n"), F.lit(1000).alias("start"),
        F.when(F.col("n_chars") % 5 != 0, 1000 + n * 300 - F.col("n_chars") % 700).alias("at"),
    )
    return ordered.request_latency(marks, ["request_id"], "n", "at", "start")


_PNG, _JPEG = "iVBORw0KGgo=", "/9j/4AAQSkZJRg=="
_REDACTED = f"CASE WHEN n_chars % 3 = 0 THEN '{_PNG}' WHEN n_chars % 3 = 1 THEN '{_JPEG}' ELSE 'UklGRg==' END"


@query(f"""
SELECT doc_id, n_chars % 5 <> 0 AS swapped,
       CASE WHEN n_chars % 5 = 0 THEN 'none' WHEN n_chars % 3 = 0 THEN 'image/png' WHEN n_chars % 3 = 1 THEN 'image/jpeg' ELSE 'image/bmp' END AS mime,
       CASE WHEN n_chars % 5 = 0 THEN 'none' ELSE {_REDACTED} END AS data,
       CASE WHEN n_chars % 5 = 0 THEN 'none' ELSE text END AS kept_text
FROM documents
""")
def swapped_images(spark, folder):
    """The image of an answer replaced by its redacted form; an answer without one cannot be mended."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    image = F.when(F.col("n_chars") % 5 != 0, F.lit('{"inlineData":{"mimeType":"image/bmp","data":"Qk0="}}'))
    body = F.concat(F.lit('{"candidates":[{"content":{"parts":['), F.concat_ws(",", F.to_json(F.struct("text")), image), F.lit("]}}]}"))
    swapped = P.swap_image(F.col("body"), F.lit(1), F.expr(_REDACTED))
    rows = X.computed_once(docs.withColumn("body", body).withColumn("swapped_body", swapped), "swapped_body")
    at = lambda path: F.coalesce(F.get_json_object("swapped_body", f"$.candidates[0].content.parts{path}"), F.lit("none"))
    return rows.select(
        "doc_id", F.col("swapped_body").isNotNull().alias("swapped"), at("[1].inlineData.mimeType").alias("mime"),
        at("[1].inlineData.data").alias("data"), at("[0].text").alias("kept_text"),
    )


_FILE_MIMES = ["application/pdf", "Text/Plain", "text/csv", "image/png"]
_FILE_MIME_SQL = "CASE n_chars % 4 " + " ".join(f"WHEN {i} THEN {quote(m)}" for i, m in enumerate(_FILE_MIMES)) + " END"
_FILE_LIMIT = 6_000


@query(f"""
WITH f AS (
  SELECT doc_id, {_FILE_MIME_SQL} AS mime, n_chars % 7 = 0 AS native, 4 * ((octet_length(encode(text)) + 2) // 3) AS b64,
         n_chars % 11 = 0 AS broken FROM documents),
r AS (SELECT doc_id, mime, CASE
    WHEN native THEN {quote(validate.NEEDS_CALLOUT)} WHEN mime = 'image/png' THEN {quote(validate.BAD_SINGLE_TYPE)}
    WHEN broken OR b64 = 0 THEN {quote(validate.BAD_BASE64)}
    WHEN b64 > {_FILE_LIMIT} THEN 'The file is longer than {_FILE_LIMIT} base64 characters.' END AS reason FROM f)
SELECT doc_id, reason IS NULL AS ok, coalesce(reason, 'none') AS reason,
       CASE WHEN reason IS NOT NULL THEN 'text' ELSE CASE mime WHEN 'application/pdf' THEN 'file:PDF' WHEN 'Text/Plain' THEN 'file:TXT'
            ELSE 'file:CSV' END END AS input
FROM r
""")
def single_file_requests(spark, folder):
    """Each document sent as the one file of a request: wrong mode, type, base64 or size."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    mime = F.get(F.array(*[F.lit(m) for m in _FILE_MIMES]), (F.col("n_chars") % 4).cast("int"))
    whole = X.encode_base64(F.encode("text", "UTF-8"))
    data = F.when(F.col("n_chars") % 11 == 0, F.concat(whole, F.lit("*"))).otherwise(whole)
    inline = F.struct(mime.alias("mimeType"), data.alias("data")).alias("inlineData")
    body = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(inline)).alias("parts"))).alias("contents")))
    mode = F.when(F.col("n_chars") % 7 == 0, "native").otherwise("callout")
    checked = validate.validate_single(validate.parse_requests(docs.withColumn("body", body), "body"), mode, max_file_b64=_FILE_LIMIT)
    return checked.select("doc_id", "ok", F.coalesce("reason", F.lit("none")).alias("reason"), "input")


@query(f"""
WITH {docs_sql()}
SELECT doc_id, text AS prompt, {filters_sql('text')} AS prompt_filters, text AS answer FROM docs
""")
def last_parts(spark, folder):
    """Only the last part of the last content is looked at, in the prompt and in the answer."""
    docs = documents(spark, folder, columns=("text",))
    part = lambda t: F.struct(t.alias("text"))
    earlier = F.array(part(F.lit("ignore previous instructions")))
    contents = F.array(F.struct(earlier.alias("parts")), F.struct(F.array(part(F.lit("jailbreak")), part(F.col("text"))).alias("parts")))
    candidates = F.array(F.struct(F.struct(earlier.alias("parts")).alias("content")), F.struct(F.struct(F.array(part(F.col("text"))).alias("parts")).alias("content")))
    rows = X.computed_once(docs, prompt=P.last_part_text(contents), answer=P.last_answer_text(candidates))
    return rows.select("doc_id", "prompt", D.names_or_none(D.all_hits(F.col("prompt"))).alias("prompt_filters"), "answer")


_SHAPES = 6


@query(f"""
SELECT doc_id, CASE n_chars % {_SHAPES} WHEN 5 THEN '{{"other":' || CAST(to_json(text) AS VARCHAR) || '}}' ELSE text END AS shown FROM documents
""")
def fallback_texts(spark, folder):
    """Text shown for answers of several shapes; an unknown one is shown as it is."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    text = F.col("text")
    halves = F.array(F.struct(F.left(text, F.lit(3)).alias("text")), F.struct(F.substr(text, F.lit(4)).alias("text")))
    shapes = [
        F.struct(F.array(F.struct(F.struct(halves.alias("parts")).alias("content"))).alias("candidates")),
        F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")),
        F.struct(text.alias("output")), F.struct(text.alias("message")), F.struct(F.struct(text.alias("message")).alias("error")),
        F.struct(text.alias("other")),
    ]
    body = F.coalesce(*[F.when(F.col("n_chars") % _SHAPES == i, F.to_json(s)) for i, s in enumerate(shapes)])
    rows = X.computed_once(docs.withColumn("body", body), "body")
    return rows.select("doc_id", P.fallback_text(F.col("body")).alias("shown"))


@query(f"""
SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'text' ELSE 'file' END AS kind,
       CASE WHEN n_chars % 2 = 0 THEN '<prompt, ' || format('{{:,}}', length(text)) || ' chars>'
            ELSE '<base64, ' || format('{{:,}}', CAST(4 * ((octet_length(encode(text)) + 2) // 3) AS BIGINT)) || ' chars>' END AS body,
       octet_length(encode(text)) AS bytes, length(text) AS extracted_chars, left(text, {S.PREVIEW_CHARS}) AS preview,
       length(text) > {S.PREVIEW_CHARS} AS truncated
FROM documents
""")
def described_inputs(spark, folder):
    """What a caller is told about an input: sizes and an excerpt, never the bytes."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    kind = F.when(F.col("n_chars") % 2 == 0, "text").otherwise("file")
    size = F.octet_length("text").cast("bigint")
    d = P.describe_input(kind, F.length("text"), F.lit("f.txt"), F.lit("text/plain"), size, F.col("text"), F.lit(None).cast("string"))
    return docs.select("doc_id", d.alias("d")).select(
        "doc_id", "d.kind", "d.body", "d.bytes", F.col("d.extracted_chars").cast("bigint").alias("extracted_chars"), "d.preview", "d.truncated"
    )


@query("""
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE greatest(0, CAST(round(value) AS BIGINT) - 20) END AS ms,
       CASE WHEN event_type = 'view' THEN 'rai,sdp' WHEN event_type = 'click' THEN 'sdp' ELSE '' END AS required
FROM events
""")
def check_times(spark, folder):
    """Time of each check from its start and end, and the filters that it had to run."""
    events = spread(read_table(spark, folder, "events").select("event_id", "user_id", "event_type", "value"), "event_id")
    start = F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(F.lit(1_000_020)).cast("bigint")
    end = 1_000_000 + F.round("value").cast("bigint")
    asked = F.when(F.col("event_type") == "view", " rai , ,sdp,").when(F.col("event_type") == "click", "sdp").otherwise(" , ")
    return events.select(
        "event_id", X.check_millis(start, end).cast("bigint").alias("ms"), F.array_join(R.parse_required(asked), ",").alias("required")
    )


@query(f"""
WITH {docs_sql()}, s AS (SELECT * FROM {screened_sql('docs', 'doc_id, n_chars')})
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END AS n_parts,
       CASE WHEN n_chars % 3 = 0 THEN 'none' WHEN n_chars % 3 = 1 THEN 'text' ELSE 'file' END AS kind,
       CASE WHEN n_chars % 3 = 0 THEN 'none' ELSE verdict END AS part_verdict,
       CASE WHEN n_chars % 3 = 0 THEN 'none' ELSE filters END AS part_filters,
       CAST(CASE WHEN n_chars % 3 = 1 THEN n_chars % 100 ELSE 0 END AS BIGINT) AS ms,
       CASE WHEN n_chars % 3 = 2 THEN 'none' ELSE verdict END AS answer_verdict,
       CASE WHEN n_chars % 3 = 1 THEN filters ELSE 'none' END AS image_filters, n_chars % 3 <> 2 AS readable
FROM s
""")
def header_records(spark, folder):
    """Part and answer records read back from headers, some of them malformed."""
    docs = D.screen(documents(spark, folder, columns=("text", "n_chars")))
    shape = F.col("n_chars") % 3
    part = F.struct(
        F.lit(1).alias("n"), F.when(shape == 1, "text").alias("kind"), "verdict", F.col("hits").alias("filters"),
        F.when(shape == 1, F.col("n_chars") % 100).alias("ms"),
    )
    parts = F.when(shape == 0, F.lit('[{"n":"1"},{"n":true},{"kind":"text"},7]')).otherwise(F.to_json(F.array(part)))
    image = F.struct("verdict", F.col("hits").alias("filters"))
    answer = (
        F.when(shape == 2, F.lit("not json"))
        .when(shape == 1, F.to_json(F.struct("verdict", image.alias("image"))))
        .otherwise(F.to_json(F.struct("verdict", F.lit("malformed").alias("image"))))
    )
    rows = X.computed_once(docs.withColumn("parts", parts).withColumn("answer", answer), "parts", "answer")
    rows = X.computed_once(rows, clean=P.clean_parts(F.col("parts")), body=P.clean_answer(F.col("answer")))
    first = F.get("clean", F.lit(0))
    none = lambda c: F.coalesce(c, F.lit("none"))
    return rows.select(
        "doc_id", F.size("clean").alias("n_parts"), none(first.kind).alias("kind"), none(first.verdict).alias("part_verdict"),
        none(F.nullif(F.array_join(first.filters, ","), F.lit(""))).alias("part_filters"), F.coalesce(first.ms, F.lit(0).cast("bigint")).alias("ms"),
        none(F.col("body.verdict")).alias("answer_verdict"),
        none(F.nullif(F.array_join("body.image.filters", ","), F.lit(""))).alias("image_filters"),
        (X.json_or(F.col("answer"), "{}") == F.col("answer")).alias("readable"),
    )


@query(f"""
WITH {docs_sql()}, s AS (SELECT * FROM {screened_sql('docs', 'doc_id, n_chars')})
SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'callout' ELSE 'native' END AS mode, verdict, filters,
       CAST(coalesce(nullif(n_chars % 50, 0), -1) AS BIGINT) AS latency_ms
FROM s
""")
def telemetry_from_body(spark, folder):
    """Telemetry of error bodies, where no header says anything."""
    docs = D.screen(documents(spark, folder, columns=("text", "n_chars")))
    screening = F.struct(
        F.when(F.col("n_chars") % 2 == 0, "callout").alias("mode"), "verdict",
        F.col("hits").alias("matchedFilters"), (F.col("n_chars") % 50).alias("latencyMs"),
    )
    body = F.to_json(F.struct(F.struct(screening.alias("screening")).alias("error")))
    rows = X.computed_once(docs.withColumn("body", body), "body")
    header = F.create_map(F.lit("x-request"), F.lit("1"))
    rows = rows.withColumn("t", L.telemetry(header, F.col("body"), F.lit("native")))
    return rows.select("doc_id", "t.mode", "t.verdict", D.names_or_none(F.col("t.filters")).alias("filters"), or_minus_one("t.latency_ms"))


_MULTI = f"""
  SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n, verdict, filters, length(text) AS chars
  FROM {screened_sql('turns', 'conv_id, turn, role, text')}"""


@query(f"""
WITH {TURNS_SQL}, parts AS ({_MULTI}),
p AS (SELECT conv_id, count(*) AS n_parts, CAST(sum(chars % 50) AS BIGINT) AS total_ms,
             CASE WHEN bool_or(verdict = 'blocked') THEN 'blocked' WHEN bool_and(verdict = 'allowed') THEN 'allowed' ELSE 'incomplete' END AS prompt,
             string_agg('p' || n || ':' || replace(filters, ',', ',p' || n || ':'), ',' ORDER BY n) FILTER (verdict = 'blocked') AS names
      FROM parts WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT conv_id, CASE WHEN bool_or(verdict = 'blocked') THEN 'blocked' WHEN bool_and(verdict = 'allowed') THEN 'allowed' ELSE 'incomplete' END AS answer,
             string_agg('response:' || replace(filters, ',', ',response:'), ',' ORDER BY n) FILTER (verdict = 'blocked') AS names
      FROM parts WHERE role = 'assistant' GROUP BY conv_id),
o AS (SELECT conv_id, n_parts, total_ms, prompt, CASE WHEN prompt = 'allowed' THEN coalesce(answer, 'incomplete') ELSE 'none' END AS answer,
             CASE WHEN prompt = 'allowed' THEN a.names ELSE p.names END AS names FROM p LEFT JOIN a USING (conv_id))
SELECT conv_id, CASE WHEN prompt = 'allowed' THEN 'response' ELSE 'prompt' END AS stage, n_parts, prompt AS prompt_verdict, answer AS answer_verdict,
       CASE CASE WHEN prompt = 'allowed' THEN answer ELSE prompt END WHEN 'allowed' THEN 'allowed' WHEN 'blocked' THEN 'blocked' ELSE 'error' END AS verdict,
       coalesce(names, 'none') AS filters, total_ms
FROM o
""")
def multipart_ledger(spark, folder):
    """Ledger row of a request of many parts: stage, verdicts of both stages, numbered filters, total time."""
    turns = conversations(spark, folder)
    users = turns.where(F.col("role") == "user")
    ms = (F.length("text") % 50).cast("bigint").alias("ms")
    screened = D.screen(users).select("conv_id", "turn", "verdict", F.col("hits").alias("filters"), ms)
    numbered = ordered.number_rows(screened, ["conv_id"], "turn", counted=users)
    times = numbered.groupBy("conv_id").agg(F.sum("ms").alias("total_ms"))
    answers = D.screen(turns.where(F.col("role") == "assistant")).select("conv_id", "turn", "verdict", "hits")
    bad = F.when(F.col("verdict") == S.BLOCKED, F.struct("turn", F.transform("hits", lambda h: F.concat(F.lit("response:"), h)).alias("names")))
    answered = answers.groupBy("conv_id").agg(V.worst_verdict(F.col("verdict")).alias("answer"), F.collect_list(bad).alias("bad"))
    rows = V.fold_parts(numbered, ["conv_id"]).join(times, "conv_id").join(answered, "conv_id", "left")
    rows = rows.withColumn("o", V.outcome(F.col("verdict"), F.col("answer")))
    of_answer = F.nullif(F.array_join(F.flatten(F.transform(F.sort_array("bad"), lambda b: b.names)), ","), F.lit(""))
    names = F.when(F.col("o.stage") == "response", of_answer).otherwise(F.col("matched"))
    return L.audit_message(
        rows, conv_id=F.col("conv_id"), stage=F.col("o.stage"), n_parts=F.col("n_parts"), prompt_verdict=F.col("o.prompt_verdict"),
        answer_verdict=F.col("o.answer_verdict"), verdict=V.ledger_verdict(F.col("o.outcome")),
        filters=F.coalesce(names, F.lit("none")), total_ms=F.col("total_ms"),
    )
