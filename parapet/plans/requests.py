"""Queries over requests, answers and conversations."""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import detect as D, results as R, scalars as X
from parapet.operators import compare, ordered, parts as P, validate, verdicts as V
from parapet.plans.common import (
    TURNS_SQL, conversations, filters_sql, or_minus_one, query, quote, screened_sql,
)
from parapet.sources.readers import read_table, spread
from parapet.sources.writers import allowed_only

# --- validation ---------------------------------------------------------------------

_SHAPE = quote(validate.single_shape_reason(S.MAX_TEXT_CHARS))


@query(f"""
WITH {TURNS_SQL}
SELECT conv_id, turn,
       CASE WHEN length(text) % 3 = 0 THEN 'callout' ELSE 'native' END AS mode,
       role = 'user' AND length(text) <= {S.MAX_TEXT_CHARS} AND regexp_matches(text, '\\S') AS ok,
       CASE WHEN role = 'user' AND length(text) <= {S.MAX_TEXT_CHARS} AND regexp_matches(text, '\\S') THEN 'none'
            ELSE {_SHAPE} END AS reason,
       'text' AS input,
       coalesce(scenario_id, 'custom') AS scenario,
       length(text) <= {S.MAX_PROMPT_CHARS} AND regexp_matches(text, '\\S') AS prompt_ok,
       CASE WHEN NOT regexp_matches(text, '\\S') THEN 'a prompt must hold text'
            WHEN length(text) > {S.MAX_PROMPT_CHARS} THEN 'a prompt is limited to {S.MAX_PROMPT_CHARS} characters' ELSE 'none' END
         AS prompt_reason
FROM turns
""")
def validate_requests(spark, folder):
    turns = conversations(spark, folder)
    part = F.struct(F.col("text"))
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    body = F.to_json(F.struct(
        F.array(F.struct(role.alias("role"), F.array(part).alias("parts"))).alias("contents"),
        F.lit("dropped").alias("systemInstruction"),
    ))
    mode = F.when(F.length("text") % 3 == 0, " CallOut ").when(F.length("text") % 3 == 1, "skip")
    requests = turns.withColumn("body", body).withColumn("mode", validate.normalize_mode(mode))
    requests = validate.validate_single(validate.parse_requests(requests, "body"), F.col("mode"))
    requests = validate.validate_prompt(
        requests.withColumn("sid", F.coalesce("scenario_id", F.concat(F.lit("conv-"), F.col("conv_id")))), "text", "sid"
    )
    none = lambda c: F.coalesce(F.col(c), F.lit("none")).alias(c)
    return requests.select(
        "conv_id", "turn", "mode", "ok", none("reason"), "input", F.col("prompt_scenario").alias("scenario"),
        "prompt_ok", none("prompt_reason"),
    )


# Smaller limits than the defaults, so that documents of a few KB reach every branch.
_LIMITS = dict(max_chars=2000, max_files=3, max_part=12_000, max_total=20_000)
_MIMES = ["image/png", "application/pdf", "text/csv", "text/plain", "image/bmp",
          "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "image/webp"]
_MIME_SQL = "CASE n_chars % 7 " + " ".join(f"WHEN {i} THEN {quote(m)}" for i, m in enumerate(_MIMES)) + " END"
_KNOWN = ", ".join(quote(m) for m in S.MIME_TYPES)


@query(f"""
WITH p AS (
  SELECT doc_id // 4 AS request_id, doc_id % 4 AS pos, doc_id % 4 = 0 AS is_text, {_MIME_SQL} AS mime,
         length(text) AS n_text, regexp_matches(text, '\\S') AS filled,
         length(to_base64(encode(text))) - CASE WHEN n_chars % 11 = 0 THEN 1 ELSE 0 END AS b64
  FROM documents),
t AS (SELECT *, sum(CASE WHEN is_text THEN 0 ELSE b64 END) OVER (PARTITION BY request_id ORDER BY pos) AS running FROM p),
r AS (SELECT *, CASE
    WHEN is_text AND (NOT filled OR n_text > {_LIMITS['max_chars']}) THEN {quote(validate.multi_shape_reason(2000, 3))}
    WHEN is_text THEN NULL
    WHEN mime NOT IN ({_KNOWN}) THEN 'This file type is not accepted: ' || mime || '.'
    WHEN b64 = 0 OR b64 % 4 <> 0 THEN {quote(validate.BAD_BASE64)}
    WHEN b64 > {_LIMITS['max_part']} THEN {quote(validate.PART_TOO_LARGE)}
    WHEN running > {_LIMITS['max_total']} THEN 'The files are longer than {_LIMITS['max_total']} base64 characters together.'
  END AS reason FROM t)
SELECT request_id, count(*) AS n_parts, count(*) FILTER (NOT is_text) AS n_files,
       CAST(sum(CASE WHEN is_text THEN 0 ELSE b64 END) AS BIGINT) AS total_base64,
       min(reason) IS NULL AS ok, coalesce(arg_min(reason, pos), 'none') AS reason
FROM r GROUP BY request_id
""")
def validate_parts(spark, folder):
    """Four documents make a request: the first is its text, the others are attachments."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    is_text = F.col("doc_id") % 4 == 0
    mime = F.get(F.array(*[F.lit(m) for m in _MIMES]), (F.col("n_chars") % 7).cast("int"))
    whole = X.encode_base64(F.encode("text", "UTF-8"))
    data = F.when(F.col("n_chars") % 11 == 0, F.left(whole, F.length(whole) - 1)).otherwise(whole)
    rows = docs.select(
        F.floor(F.col("doc_id") / 4).alias("request_id"),
        (F.col("doc_id") % 4).alias("pos"),
        F.when(is_text, "text").otherwise("file").alias("kind"),
        F.when(is_text, F.col("text")).alias("text"),
        mime.alias("mime"),
        F.when(~is_text, data).alias("data"),
    )
    facts = rows.select(
        "request_id", "pos", validate.part_facts(F.col("kind"), F.col("text"), F.col("mime"), F.col("data")).alias("facts")
    )
    checked = validate.validate_part_rows(facts, ["request_id"], "pos", "facts", **_LIMITS)
    return checked.withColumn("reason", F.coalesce("reason", F.lit("none")))


_EXTS = [".pdf", ".txt", ".md", ".JSON", ".csv", ".exe", ""]
_EXT_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {quote(e)}" for i, e in enumerate(_EXTS)) + " END"
_EXT_OK = ", ".join(quote(e) for e in S.UPLOAD_TYPES)
_MIME_OF = "CASE ext " + " ".join(f"WHEN {quote(e)} THEN {quote(m)}" for e, (m, _) in S.UPLOAD_TYPES.items()) + " END"
_KIND_OF = "CASE ext " + " ".join(f"WHEN {quote(e)} THEN {quote(k)}" for e, (_, k) in S.UPLOAD_TYPES.items()) + " END"
_UPLOAD_LIMIT = 20_000


@query(f"""
WITH u AS (
  SELECT doc_id, left(regexp_replace(source || '#' || doc_id || {_EXT_SQL}, '[^A-Za-z0-9._ ()-]', '_', 'g'), 120) AS safe_name,
         lower({_EXT_SQL}) AS ext, octet_length(encode(text)) AS bytes, n_chars % 13 = 0 AS broken FROM documents),
r AS (SELECT *, CASE
    WHEN ext NOT IN ({_EXT_OK}) THEN 'This file type is not accepted; known are {', '.join(sorted(S.UPLOAD_TYPES))}'
    WHEN broken THEN 'dataBase64 is no standard base64'
    WHEN bytes > {_UPLOAD_LIMIT} THEN 'File exceeds ' || printf('%.1f', {_UPLOAD_LIMIT} / 1024.0) || ' KB'
    WHEN ext = '.pdf' THEN 'This is not a valid PDF file' END AS reason FROM u)
SELECT doc_id, safe_name, ext, coalesce({_MIME_OF}, 'none') AS mime, coalesce({_KIND_OF}, 'none') AS kind,
       CASE WHEN ext IN ({_EXT_OK}) AND NOT broken THEN CAST(bytes AS BIGINT) ELSE -1 END AS bytes,
       CAST(CASE WHEN reason IS NULL THEN 200 WHEN reason LIKE 'File exceeds%' THEN 413 ELSE 400 END AS BIGINT) AS status,
       coalesce(reason, 'none') AS reason
FROM r
""")
def validate_uploads(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "source", "n_chars"), "doc_id")
    ext = F.get(F.array(*[F.lit(e) for e in _EXTS]), (F.col("doc_id") % 7).cast("int"))
    whole = X.encode_base64(F.encode("text", "UTF-8"))
    uploads = docs.select(
        "doc_id",
        F.concat(F.lit("C:\\tmp/"), "source", F.lit("#"), "doc_id", ext).alias("filename"),
        F.when(F.col("n_chars") % 13 == 0, F.concat(F.lit("*"), F.substring(whole, 2, 10_000_000))).otherwise(whole)
        .alias("data_base64"),
    )
    checked = validate.validate_upload(uploads, max_bytes=_UPLOAD_LIMIT)
    return checked.select(
        "doc_id", "safe_name", "ext", F.coalesce("mime", F.lit("none")).alias("mime"),
        F.coalesce("kind", F.lit("none")).alias("kind"), or_minus_one("bytes"), F.col("status").cast("bigint").alias("status"),
        F.coalesce("reason", F.lit("none")).alias("reason"),
    )


# --- parts -----------------------------------------------------------------------------


def _user_parts(turns, columns):
    """User turns numbered 1.. within their conversation; the counting reads no text."""
    return ordered.number_rows(turns.select("conv_id", "turn", *columns), ["conv_id"], "turn", counted=turns)


@query(f"""
WITH {TURNS_SQL}
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, 'text' AS kind, 'text/plain' AS mime,
       length(text) AS bytes, true AS forwarded
FROM turns WHERE role = 'user'
""")
def conversation_parts(spark, folder):
    turns = conversations(spark, folder).where(F.col("role") == "user")
    numbered = _user_parts(turns, [F.length("text").cast("bigint").alias("bytes")])
    return numbered.select(
        "conv_id", "turn", "n", F.lit("text").alias("kind"), F.lit("text/plain").alias("mime"), "bytes", F.lit(True).alias("forwarded")
    )


_SPLIT_MIME = "CASE WHEN doc_id % 4 = 0 THEN 'text/plain' ELSE " + _MIME_SQL + " END"
_KIND_SQL = "CASE mime " + " ".join(f"WHEN {quote(m)} THEN {quote(k)}" for m, (k, _) in S.MIME_TYPES.items()) + " END"
_READABLE = ", ".join(quote(m) for m, (_, t) in S.MIME_TYPES.items() if t)


@query(f"""
WITH p AS (
  SELECT doc_id, {_MIME_SQL} AS mime, octet_length(encode(text)) AS bytes, length(text) AS chars FROM documents),
ok AS (SELECT *, CAST(4 * ((bytes + 2) // 3) AS BIGINT) AS b64 FROM p WHERE mime IN ({_KNOWN}))
SELECT doc_id, CAST(1 AS BIGINT) AS n, 'text' AS kind, 'text/plain' AS mime, CAST(20 AS BIGINT) AS bytes, true AS forwarded FROM ok
UNION ALL
SELECT doc_id, 2, {_KIND_SQL}, mime, CAST(b64 * 3 // 4 AS BIGINT), mime IN ({_READABLE}) FROM ok
""")
def request_parts(spark, folder):
    """Each document attached to one request: the file comes first, the text still is part 1."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    mime = F.get(F.array(*[F.lit(m) for m in _MIMES]), (F.col("n_chars") % 7).cast("int"))
    inline = F.struct(F.upper(mime).alias("mimeType"), X.encode_base64(F.encode("text", "UTF-8")).alias("data"))
    file = F.struct(F.lit(None).cast("string").alias("text"), inline.alias("inlineData"))
    ask = F.struct(F.lit("Summarise this file.").alias("text"), F.lit(None).cast("struct<mimeType:string,data:string>").alias("inlineData"))
    contents = F.array(F.struct(F.lit("user").alias("role"), F.array(file, ask).alias("parts")))
    requests = X.computed_once(docs.select("doc_id", contents.alias("contents")), "contents")
    requests = X.computed_once(validate.shape_columns(requests, "contents"), "parts")
    accepted = validate.validate_multipart(requests).where("ok")
    rows = P.split_parts(accepted, ["doc_id"])
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n"), "kind", "mime", "bytes", "forwarded")


@query(f"""
WITH {TURNS_SQL}
SELECT conv_id, count(*) AS n_parts, CAST(sum(length(text)) AS BIGINT) AS total_bytes, max(length(text)) AS largest
FROM turns WHERE role = 'user' GROUP BY conv_id
""")
def part_totals(spark, folder):
    turns = conversations(spark, folder).where(F.col("role") == "user")
    sized = turns.select("conv_id", F.length("text").cast("bigint").alias("bytes"))
    return sized.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("largest")
    )


@query("""
SELECT doc_id // 4 AS request_id, doc_id % 4 + 1 AS n,
       CASE WHEN doc_id % 4 = 0 THEN 'Prompt text' WHEN lang = 'en' THEN source || '-' || doc_id || '.txt'
            ELSE 'part ' || (doc_id % 4 + 1) END AS name
FROM documents
""")
def part_names(spark, folder):
    """File names by part number; only English documents have their name on record."""
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "source")
    keyed = docs.withColumn("request_id", F.floor(F.col("doc_id") / 4)).withColumn("n", F.col("doc_id") % 4 + 1)
    files = keyed.where((F.col("n") >= 2) & (F.col("lang") == "en")).select(
        "request_id", "n", F.concat(F.concat_ws("-", "source", "doc_id"), F.lit(".txt")).alias("file_name")
    )
    return P.part_records(keyed.select("request_id", "n"), files, ["request_id"])


_ATT_LIMITS = dict(max_bytes=9_000, max_total=15_000)
_ATT_EXTS = [".png", ".PDF", ".csv", ".gif", ".docx"]
_ATT_EXT_SQL = "CASE n_chars % 5 " + " ".join(f"WHEN {i} THEN {quote(e)}" for i, e in enumerate(_ATT_EXTS)) + " END"


@query(f"""
WITH a AS (
  SELECT doc_id, n_chars % 4 + 1 AS n, octet_length(encode(text)) AS bytes, {_ATT_EXT_SQL} AS ext, n_chars % 17 = 0 AS broken
  FROM documents)
SELECT doc_id, n AS n_files,
       CASE WHEN n > 3 THEN 'No more than 3 files.'
            WHEN ext = '.gif' THEN '''.gif'' files are not accepted; known are {', '.join(sorted(S.ATTACHMENT_TYPES))}.'
            WHEN broken THEN 'f_1' || ext || ': dataBase64 is no standard base64.'
            WHEN bytes > {_ATT_LIMITS['max_bytes']} THEN 'f_1' || ext || ' exceeds 4 MB.'
            WHEN bytes * n > {_ATT_LIMITS['max_total']} THEN 'The files exceed 5 MB together.' ELSE 'none' END AS reason,
       CASE WHEN broken OR n > 3 OR ext = '.gif' THEN 0 ELSE CAST(bytes * n AS BIGINT) END AS total_bytes
FROM a
""")
def validate_attachments(spark, folder):
    """Each document attached one to four times."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    whole = X.encode_base64(F.encode("text", "UTF-8"))
    docs = docs.withColumn("n", F.col("n_chars") % 4 + 1).withColumn(
        "data", F.when(F.col("n_chars") % 17 == 0, F.concat(whole, F.lit("*"))).otherwise(whole)
    )
    docs = X.computed_once(docs, "data")
    ext = F.get(F.array(*[F.lit(e) for e in _ATT_EXTS]), (F.col("n_chars") % len(_ATT_EXTS)).cast("int"))
    files = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(
        F.concat(F.lit("dir\\f#"), i.cast("string"), ext).alias("name"), F.col("data").alias("dataBase64")
    ))
    checked = validate.validate_attachments(docs.withColumn("files", files), **_ATT_LIMITS)
    sizes = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, f: a + F.coalesce(f.bytes, F.lit(0)))
    known = F.size(F.filter("attachments", lambda f: f.mime.isNotNull())) == F.col("n")
    return checked.select(
        "doc_id", F.col("n").alias("n_files"), F.coalesce("reason", F.lit("none")).alias("reason"),
        F.when(known & (F.col("n") <= 3), sizes).otherwise(F.lit(0).cast("bigint")).alias("total_bytes"),
    )


# --- screening conversations ---------------------------------------------------------------


def _screened_parts(spark, folder):
    """(conv_id, n, verdict, filters) of every turn; only user turns have a part number.

    Turns are screened where they are read; from then on only names travel.
    """
    turns = conversations(spark, folder)
    users = turns.where(F.col("role") == "user")
    screened = D.screen(users).select("conv_id", "turn", "verdict", F.col("hits").alias("filters"), F.length("text").cast("bigint").alias("bytes"))
    numbered = ordered.number_rows(screened, ["conv_id"], "turn", counted=users)
    null = lambda kind: F.lit(None).cast(kind)
    others = turns.where(F.col("role") != "user").select(
        "conv_id", null("bigint").alias("n"), null("string").alias("verdict"), X.empty_strings().alias("filters"),
        null("bigint").alias("bytes"),
    )
    return numbered.select("conv_id", "n", "verdict", "filters", "bytes").unionByName(others)


_PART_ROWS = f"""
  SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n, verdict, filters
  FROM {screened_sql('turns', 'conv_id, turn, role')}"""
_FOLDED = """
  SELECT conv_id, count(*) FILTER (role = 'user') AS n_parts,
         CASE WHEN bool_or(verdict = 'blocked') FILTER (role = 'user') THEN 'blocked'
              WHEN bool_and(verdict = 'allowed') FILTER (role = 'user') THEN 'allowed' ELSE 'incomplete' END AS verdict,
         coalesce(string_agg('p' || n || ':' || replace(filters, ',', ',p' || n || ':'), ',' ORDER BY n)
                  FILTER (role = 'user' AND verdict = 'blocked'), 'none') AS matched,
         count(*) FILTER (role = 'user') > 4 AS over_limit
  FROM parts GROUP BY conv_id"""
_JUDGED = f"""
  SELECT * REPLACE (CASE WHEN over_limit AND verdict <> 'blocked' THEN 'error' ELSE verdict END AS verdict) FROM ({_FOLDED})"""


def _judged(spark, folder):
    """Folded requests; one of too many parts that is not blocked is an error."""
    folded = V.fold_parts(_screened_parts(spark, folder), ["conv_id"])
    return folded.withColumn("verdict", V.request_verdict(F.col("verdict"), F.col("over_limit")))


@query(f"WITH {TURNS_SQL}, parts AS ({_PART_ROWS}) {_FOLDED}")
def screen_conversations(spark, folder):
    return V.fold_parts(_screened_parts(spark, folder), ["conv_id"])


@query(f"""
WITH {TURNS_SQL}, parts AS ({_PART_ROWS}), u AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) AS bytes FROM turns WHERE role = 'user')
SELECT conv_id, n, CASE WHEN n = 1 THEN 'Prompt text' ELSE 'part ' || n END AS name, 'text' AS kind, bytes, verdict, filters
FROM u JOIN (SELECT conv_id, n, verdict, filters FROM parts WHERE role = 'user') USING (conv_id, n)
""")
def part_records(spark, folder):
    """One names-only record per part: its verdict beside its size and kind."""
    screened = _screened_parts(spark, folder).where(F.col("n").isNotNull())
    records = screened.withColumn("name", P.part_name(F.col("n"))).withColumn("kind", F.lit("text"))
    return records.select("conv_id", "n", "name", "kind", "bytes", "verdict", D.names_or_none(F.col("filters")).alias("filters"))


@query(f"""
WITH {TURNS_SQL}, parts AS ({_PART_ROWS}), f AS ({_JUDGED})
SELECT conv_id, '{{"error":{{"code":' || CASE verdict WHEN 'incomplete' THEN '503' ELSE '400' END || ',"status":"' ||
         CASE verdict WHEN 'blocked' THEN 'BLOCKED_BY_SCREENING' WHEN 'error' THEN 'INVALID_ARGUMENT' ELSE 'SCREENING_UNAVAILABLE' END
         || '","stage":"prompt","message":"' || verdict || '","screening":{{"mode":"callout","matched":"' || matched ||
         '","latencyMs":0}},"requestId":"req-' || conv_id || '"}}}}' AS body
FROM f WHERE verdict <> 'allowed'
""")
def error_records(spark, folder):
    """The error body of every conversation that is not forwarded."""
    folded = _judged(spark, folder).where(F.col("verdict") != S.ALLOWED)
    status = V.outcome_status(F.col("verdict"))
    body = V.error_record(
        status.http_status, status.code, F.lit("prompt"), F.col("verdict"), F.lit("callout"), F.col("matched"), F.lit(0),
        F.concat(F.lit("req-"), "conv_id"),
    )
    return folded.select("conv_id", body.alias("body"))


@query(f"""
WITH {TURNS_SQL}, parts AS ({_PART_ROWS}), f AS ({_FOLDED})
SELECT conv_id, n_parts, n_parts > 3 AS over_limit,
       CASE WHEN n_parts > 3 THEN 'INVALID_ARGUMENT' WHEN verdict = 'blocked' THEN 'BLOCKED_BY_SCREENING'
            WHEN verdict = 'incomplete' THEN 'SCREENING_UNAVAILABLE' ELSE 'OK' END AS code
FROM f
""")
def bounded_requests(spark, folder):
    """Requests of at most three parts; larger ones are rejected, not cut."""
    folded = V.fold_parts(_screened_parts(spark, folder), ["conv_id"], max_parts=3)
    status = V.outcome_status(F.col("verdict"), F.col("over_limit"))
    return folded.select("conv_id", "n_parts", "over_limit", status.code.alias("code"))


@query(f"""
WITH {TURNS_SQL}, ends AS (
  SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_prompt,
         arg_max(text, turn) FILTER (role = 'assistant') AS last_answer, count(*) AS n_turns FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, coalesce(length(last_prompt), -1) AS prompt_chars, coalesce(length(last_answer), -1) AS answer_chars,
       CASE WHEN last_prompt IS NULL THEN 'none' ELSE {filters_sql('last_prompt')} END AS filters,
       CASE WHEN last_prompt IS NULL THEN 'incomplete' WHEN {filters_sql('last_prompt')} <> 'none' THEN 'blocked'
            WHEN length(last_prompt) > {S.MAX_TEXT_CHARS} THEN 'incomplete' ELSE 'allowed' END AS verdict
FROM ends
""")
def last_turn_prompt(spark, folder):
    """A mode in which only the last prompt of a conversation counts.

    Turns are screened where they are read, so what is aggregated and shuffled is one
    small record per conversation and task, not its texts.
    """
    turns = D.screen(conversations(spark, folder)).select(
        "conv_id", "turn", "role",
        F.struct(F.length("text").cast("bigint").alias("chars"), "verdict", D.names_or_none(F.col("hits")).alias("filters")).alias("seen"),
    )
    last = lambda role: F.max_by("seen", F.when(F.col("role") == role, F.col("turn")))
    ends = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), last("user").alias("prompt"), last("assistant").alias("answer")
    )
    return ends.select(
        "conv_id", "n_turns", F.coalesce("prompt.chars", F.lit(-1)).alias("prompt_chars"), F.coalesce("answer.chars", F.lit(-1)).alias("answer_chars"),
        F.coalesce("prompt.filters", F.lit("none")).alias("filters"),
        F.coalesce("prompt.verdict", F.lit(S.INCOMPLETE)).alias("verdict"),
    )


@query(f"""
WITH {TURNS_SQL}, parts AS ({_PART_ROWS}), f AS ({_JUDGED})
SELECT conv_id, turn,
       '{{"contents":[{{"role":"user","parts":[{{"text":' || CAST(to_json(text) AS VARCHAR) || '}}]}}]}}' AS payload
FROM turns WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM f WHERE verdict = 'allowed')
""")
def forwarded_payload(spark, folder):
    verdicts = _judged(spark, folder)
    turns = conversations(spark, folder).where(F.col("role") == "user").select("conv_id", "turn", "text")
    passed = allowed_only(turns, verdicts, ["conv_id"])
    return passed.select("conv_id", "turn", P.text_payload(F.col("text")).alias("payload"))


@query(f"""
WITH docs AS (
  SELECT doc_id, source, {_MIME_SQL} AS mime, to_base64(encode(text)) AS b64, {filters_sql('text')} AS f FROM documents),
ok AS (SELECT * FROM docs WHERE mime IN ({_KNOWN}) AND f = 'none')
SELECT doc_id, '{{"contents":[{{"role":"user","parts":[{{"text":"Summarise this file."}},' ||
       CASE WHEN mime IN ({_READABLE}) THEN '{{"inlineData":{{"mimeType":"' ||
              CASE WHEN mime = 'text/csv' THEN 'text/plain' ELSE mime END || '","data":"' || b64 || '"}}}}'
            ELSE '{{"text":"[An attached ' || CASE WHEN mime = 'image/bmp' THEN 'BMP image' ELSE 'Word document' END ||
              ' passed screening. This model cannot read that file type, so only this note is shared.]"}}' END ||
       ']}}]' || CASE WHEN source LIKE '%1' THEN ',"generationConfig":{{"responseModalities":["TEXT","IMAGE"]}}' ELSE '' END
       || '}}' AS payload
FROM ok
""")
def forwarded_files(spark, folder):
    """Multi-part payloads of documents that passed: bytes where readable, a note elsewhere."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "source", "n_chars"), "doc_id")
    mime = F.get(F.array(*[F.lit(m) for m in _MIMES]), (F.col("n_chars") % 7).cast("int"))
    part = lambda kind, text, m, data: F.struct(
        F.lit(kind).alias("kind"), text.alias("text"), m.alias("mime"), data.alias("data")
    )
    null = F.lit(None).cast("string")
    parts = F.array(
        part("text", F.lit("Summarise this file."), null, null),
        part("file", null, mime, X.encode_base64(F.encode("text", "UTF-8"))),
    )
    passed = D.screen(docs.where(mime.isin(list(S.MIME_TYPES))), max_chars=S.MAX_UPLOAD_BYTES).where(F.col("verdict") == S.ALLOWED)
    flow = validate.route_flow(F.when(F.col("source").endswith("1"), "/generate-image").otherwise("/generate"))
    built = X.computed_once(passed.select("doc_id", flow.alias("flow"), parts.alias("parts")), "parts")
    return built.select("doc_id", P.multipart_payload(F.col("parts"), F.lit("callout"), F.col("flow")).alias("payload"))


# --- answers --------------------------------------------------------------------------------


def _answers(spark, folder):
    """Assistant turns as model answers: reasoning, the text, a tool call, sometimes an image."""
    turns = conversations(spark, folder).where(F.col("role") == "assistant")
    text = F.to_json(F.struct("text"))
    mime = F.when(F.col("conv_id") % 5 == 0, "image/webp").otherwise("image/png")
    image = F.to_json(F.struct(F.struct(mime.alias("mimeType"), F.lit("iVBORw0KGgo=").alias("data")).alias("inlineData")))
    parts = F.concat_ws(
        ",",
        F.when(F.col("turn") % 3 == 0, F.lit('{"text":"let me think","thought":true}')),
        text,
        F.when(F.col("turn") % 2 == 1, F.lit('{"functionCall":{"name":"f"}}')),
        F.when(F.col("conv_id") % 2 == 0, image),
    )
    body = F.concat(
        F.lit('{"candidates":[{"content":{"parts":['), parts,
        F.lit(']}}],"usageMetadata":{"totalTokenCount":'), F.length("text").cast("string"), F.lit("}}"),
    )
    return turns.select("conv_id", "turn", F.length("text").alias("chars"), body.alias("body"))


_ANSWERS = "SELECT *, conv_id % 2 = 0 AS img, conv_id % 5 = 0 AS webp FROM turns WHERE role = 'assistant'"


@query(f"""
WITH {TURNS_SQL}, a AS ({_ANSWERS})
SELECT conv_id, turn, NOT (img AND webp) AS shape_ok, true AS has_text, img AND NOT webp AS has_image,
       CAST(CASE WHEN img AND NOT webp THEN 1 ELSE -1 END AS BIGINT) AS image_index,
       CAST(CASE WHEN img THEN 2 ELSE 1 END AS BIGINT) AS kept_parts, text AS screen_text, text AS shown_text,
       CASE WHEN img THEN CASE WHEN webp THEN 'image/webp' ELSE 'image/png' END ELSE 'none' END AS shown_image,
       length(text) AS total_tokens, false AS still_dirty
FROM a
""")
def answer_parts(spark, folder):
    rows = P.split_answer(_answers(spark, folder), F.col("body"))
    rows = rows.withColumn("shown", P.answer_text_and_image(F.col("body")))
    stripped = P.split_answer(
        rows.withColumn("stripped", P.strip_unscreened(F.col("body"))).withColumnsRenamed(
            {c: f"first_{c}" for c in ("shape_ok", "has_text", "has_image", "image_index", "kept_parts", "screen_text",
                                       "image_mime", "image_data")}
        ),
        F.col("stripped"),
    )
    all_parts = F.size(F.try_variant_get(F.try_parse_json("stripped"), "$.candidates[0].content.parts", "array<variant>"))
    return stripped.select(
        "conv_id", "turn", F.col("first_shape_ok").alias("shape_ok"), F.col("first_has_text").alias("has_text"),
        F.col("first_has_image").alias("has_image"), F.coalesce(F.col("first_image_index").cast("bigint"), F.lit(-1)).alias("image_index"),
        F.col("first_kept_parts").cast("bigint").alias("kept_parts"), F.col("first_screen_text").alias("screen_text"),
        F.col("shown.text").alias("shown_text"), F.coalesce("shown.image.mimeType", F.lit("none")).alias("shown_image"),
        P.usage_tokens(F.col("stripped")).total.alias("total_tokens"),
        (all_parts != F.col("kept_parts")).alias("still_dirty"),
    )


# Result of each answer: its text is screened, over-long text is not; images carry contact data
# (redactable), an injection (not redactable) or a result with a skipped filter.
_TEXT_VERDICT = f"CASE WHEN chars > {S.MAX_TEXT_CHARS} THEN 'incomplete' WHEN hits <> 'none' THEN 'blocked' ELSE 'allowed' END"
# A result lists its filters in its own order.
_RESULT_ORDER = ("malicious_uris", "rai:harassment", "pi_and_jailbreak", "sdp")
_BY_RESULT_ORDER = sorted(S.PROMPT_RULES, key=lambda r: _RESULT_ORDER.index(r[0]))
_IMAGE_CASE = "conv_id % 6"


@query(f"""
WITH {TURNS_SQL}, a AS (SELECT *, length(text) AS chars, {filters_sql('text', _BY_RESULT_ORDER)} AS hits FROM ({_ANSWERS})),
v AS (SELECT conv_id, turn, NOT (img AND webp) AS shape_ok, img AND NOT webp AS has_image, {_TEXT_VERDICT} AS text_verdict,
             CASE WHEN img AND NOT webp THEN 'blocked' END AS image_verdict,
             CASE WHEN conv_id % 8 < 4 THEN 'redact' ELSE 'block' END AS action,
             conv_id % 6 AS c, hits FROM a),
s AS (SELECT *, CASE WHEN NOT has_image THEN 'none' WHEN c = 2 OR action = 'block' THEN 'blocked'
                     WHEN c = 4 THEN 'incomplete' ELSE 'redacted' END AS state FROM v)
SELECT conv_id, turn, action, text_verdict, coalesce(image_verdict, 'none') AS image_verdict, state AS image_state,
       CASE WHEN text_verdict = 'blocked' OR state = 'blocked' THEN 'blocked'
            WHEN NOT shape_ok OR text_verdict = 'incomplete' OR state = 'incomplete' THEN 'incomplete'
            WHEN state = 'redacted' THEN 'redacted' ELSE 'allowed' END AS verdict,
       coalesce(nullif(concat_ws(',', CASE WHEN text_verdict = 'blocked' THEN 'text:' || replace(hits, ',', ',text:') END,
         CASE WHEN has_image THEN CASE WHEN c = 2 THEN 'image:pi_and_jailbreak' ELSE 'image:sdp' END END), ''), 'none') AS matched,
       CASE WHEN has_image AND c <> 2 THEN 'PHONE_NUMBER,EMAIL_ADDRESS' ELSE '' END AS findings,
       text_verdict AS native_verdict
FROM s
""")
def answer_verdicts(spark, folder):
    rows = P.split_answer(_answers(spark, folder), F.col("body"))
    rows = X.computed_once(
        rows, hits=D.all_hits(F.col("screen_text")), over=F.length("screen_text") > S.MAX_TEXT_CHARS
    )
    case = F.col("conv_id") % 6
    text_result = R.emulate_result(F.col("hits"), F.col("over"))
    image_result = R.emulate_result(
        F.when(case == 2, F.array(F.lit("pi_and_jailbreak"))).otherwise(F.array(F.lit("sdp"))),
        F.lit(False),
        F.when(case == 4, F.array(F.lit("rai"))).otherwise(X.empty_strings()),
        F.lit("iVBORredacted"),
        F.array(F.lit("PHONE_NUMBER"), F.lit("EMAIL_ADDRESS"), F.lit("PHONE_NUMBER")),
    )
    rows = rows.withColumn("text_result", text_result).withColumn("image_result", image_result)
    rows = R.summarize(R.summarize(rows, "text_result", prefix="t_"), "image_result", prefix="i_")
    asked = F.when(F.col("conv_id") % 8 < 4, "skip").otherwise(" Block ")
    rows = rows.withColumn("action", validate.normalize_action(asked))
    item = lambda has, col: F.when(F.col(has), F.col(col))
    rows = rows.withColumn("text_verdict", item("has_text", "t_verdict")).withColumn("image_verdict", item("has_image", "i_verdict"))
    state = V.image_state(
        F.col("image_verdict"), F.col("i_filters"), F.col("i_redacted_image").isNotNull(), F.col("i_complete"), F.col("action")
    )
    rows = rows.withColumn("image_state", state)
    return rows.select(
        "conv_id", "turn", "action", "text_verdict", F.coalesce("image_verdict", F.lit("none")).alias("image_verdict"), "image_state",
        V.answer_verdict(F.col("shape_ok"), F.col("text_verdict"), F.col("image_verdict"), F.col("image_state")).alias("verdict"),
        V.answer_matched(item("has_text", "t_filters"), item("has_image", "i_filters")).alias("matched"),
        F.array_join(F.coalesce(item("has_image", "i_findings"), X.empty_strings()), ",").alias("findings"),
        V.native_answer_verdict(F.col("text_verdict")).alias("native_verdict"),
    )


_LABEL_SQL = "replace(replace(replace(replace(f, 'pi_and_jailbreak', 'Prompt injection'), 'malicious_uris', 'Malicious URL'), " \
             "'rai:harassment', 'Responsible AI (harassment)'), 'sdp', 'Sensitive data')"


@query(f"""
WITH {TURNS_SQL}, parts AS ({_PART_ROWS}), f AS ({_JUDGED}),
ends AS (SELECT conv_id, CASE WHEN bool_or(verdict = 'blocked') THEN 'blocked' WHEN bool_and(verdict = 'allowed') THEN 'allowed'
                              ELSE 'incomplete' END AS answer,
                coalesce(string_agg(replace(filters, ',', ', '), ', ' ORDER BY n) FILTER (verdict = 'blocked'), 'none') AS answer_filters
         FROM parts WHERE role = 'assistant' GROUP BY conv_id),
o AS (SELECT conv_id, n_parts, verdict AS prompt_verdict,
             CASE WHEN verdict = 'allowed' THEN coalesce(answer_filters, 'none') ELSE matched END AS matched,
             CASE WHEN verdict = 'allowed' THEN coalesce(answer, 'incomplete') ELSE 'none' END AS answer_verdict
      FROM f LEFT JOIN ends USING (conv_id)),
x AS (SELECT *, CASE WHEN prompt_verdict = 'allowed' THEN answer_verdict ELSE prompt_verdict END AS outcome,
             replace(regexp_replace(matched, 'p[0-9]+:', '', 'g'), ',', ', ') AS f FROM o)
SELECT conv_id, outcome, CASE WHEN prompt_verdict = 'allowed' THEN 'response' ELSE 'prompt' END AS stage,
       prompt_verdict, answer_verdict,
       CAST(CASE outcome WHEN 'allowed' THEN 200 WHEN 'blocked' THEN 400 WHEN 'error' THEN 400 ELSE 503 END AS BIGINT) AS http_status,
       CASE outcome WHEN 'allowed' THEN 'OK' WHEN 'blocked' THEN 'BLOCKED_BY_SCREENING' WHEN 'error' THEN 'INVALID_ARGUMENT' ELSE 'SCREENING_UNAVAILABLE' END AS code,
       CASE outcome WHEN 'allowed' THEN 'Clean: screening found nothing.' WHEN 'blocked' THEN 'Blocked: ' || {_LABEL_SQL}
            WHEN 'error' THEN 'Request rejected: unsupported shape.' ELSE 'Held back: screening could not finish (fail closed).' END AS message,
       outcome = 'blocked' AND prompt_verdict = 'blocked' AND answer_verdict = 'none' AS like_h2
FROM x
""")
def outcome_records(spark, folder):
    # Answers are screened like prompts; a conversation without one got nothing back.
    answers = D.screen(conversations(spark, folder).where(F.col("role") == "assistant"))
    bad = F.when(F.col("verdict") == S.BLOCKED, F.struct("turn", F.array_join("hits", ", ").alias("names")))
    answered = answers.groupBy("conv_id").agg(V.worst_verdict(F.col("verdict")).alias("answer"), F.collect_list(bad).alias("bad"))
    rows = _judged(spark, folder).join(answered, "conv_id", "left").withColumn("o", V.outcome(F.col("verdict"), F.col("answer")))
    rows = rows.withColumn("s", V.outcome_status(F.col("o.outcome")))
    of_answer = F.array_join(F.transform(F.sort_array("bad"), lambda b: b.names), ", ")
    names = F.when(F.col("verdict") == S.ALLOWED, F.split(of_answer, ", ")).otherwise(
        F.split(F.regexp_replace("matched", r"p\d+:", ""), ",")
    )
    names = F.filter(names, lambda f: ~f.isin("none", ""))
    return rows.select(
        "conv_id", "o.outcome", "o.stage", "o.prompt_verdict", "o.answer_verdict",
        F.col("s.http_status").cast("bigint").alias("http_status"), "s.code",
        V.explain(F.col("o.outcome"), names, F.col("s.http_status"), F.col("s.code")).alias("message"),
        compare.verdict_triplet_ok(F.col("o"), (S.BLOCKED, S.BLOCKED, "none")).alias("like_h2"),
    )
