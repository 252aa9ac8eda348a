"""Queries that screen documents and pages."""

import zlib

import pandas as pd
from pyspark.sql import functions as F, types as T

from parapet import settings as S
from parapet.functions import detect as D, results as R, scalars as X
from parapet.operators import compare, documents as documents_text, pages, validate, verdicts as V
from parapet.plans.common import (
    SEEDS, TYPE_SEEDS, docs_sql, documents, filters_sql, n_hits_sql, normalize_sql, or_minus_one, query, quote, replace_all_sql,
    screened_sql,
)
from parapet.sources.readers import read_table, spread


@query(f"""
WITH {docs_sql()}
SELECT doc_id, verdict, filters, n_hits FROM {screened_sql('docs', 'doc_id')}
""")
def screen_documents(spark, folder):
    docs = documents(spark, folder, columns=("text",))
    return D.screen(docs).select(
        "doc_id", "verdict", D.names_or_none(F.col("hits")).alias("filters"), F.size("hits").cast("bigint").alias("n_hits")
    )


_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(text, {quote(p)}) THEN {quote(n)}" for n, p in S.PROMPT_RULES) + " END"
_SCENARIO_FILTER = "CASE scenario_id " + " ".join(
    f"WHEN {quote(s[0])} THEN {quote(s[2]) if s[2] else 'NULL'}" for s in S.SCENARIOS) + " END"


@query(f"""
WITH {docs_sql()}, hit AS (
  SELECT doc_id, scenario_id, text,
         CASE WHEN scenario_id <> 'custom' THEN {_SCENARIO_FILTER} ELSE {_FIRST} END AS f
  FROM docs)
SELECT doc_id, scenario_id, coalesce(f, 'none') AS first_filter,
       CASE WHEN f IS NOT NULL THEN 'blocked' ELSE 'allowed' END AS verdict
FROM hit
""")
def screen_first_hit(spark, folder):
    docs = documents(spark, folder, columns=("text",))
    hit = docs.withColumn("f", D.first_hit(F.col("text"), scenario=F.col("scenario_id")))
    return hit.select(
        "doc_id", "scenario_id", F.coalesce("f", F.lit("none")).alias("first_filter"),
        F.when(F.col("f").isNotNull(), S.BLOCKED).otherwise(S.ALLOWED).alias("verdict"),
    )


_UPLOAD_PROMPT = f"""{quote(S.FILE_INSTRUCTION)} || chr(10) || chr(10) || '--- Document: ' || name || ' ---' || chr(10) || text"""


@query(f"""
WITH {docs_sql()}, named AS (SELECT *, source || '-' || doc_id || '.txt' AS name FROM docs),
sized AS (SELECT *, octet_length(encode(text)) AS bytes, length({_UPLOAD_PROMPT}) AS prompt_chars,
                 {filters_sql('text', S.UPLOAD_RULES)} AS f, {n_hits_sql('text', S.UPLOAD_RULES)} AS n FROM named)
SELECT doc_id, name, CAST(bytes AS BIGINT) AS bytes,
       CAST(CASE WHEN bytes > {S.MAX_UPLOAD_BYTES} THEN 413 WHEN n > 0 THEN 400 ELSE 200 END AS BIGINT) AS http_status,
       CASE WHEN bytes > {S.MAX_UPLOAD_BYTES} THEN 'error' WHEN n > 0 THEN 'blocked' ELSE 'allowed' END AS verdict,
       CASE WHEN bytes > {S.MAX_UPLOAD_BYTES} THEN 'none' ELSE f END AS filters,
       prompt_chars <= {S.MAX_TEXT_CHARS} AS native_sent
FROM sized
""")
def screen_uploads(spark, folder):
    docs = documents(spark, folder, columns=("text", "source"))
    name = F.concat_ws("-", "source", "doc_id")
    named = docs.withColumn("name", F.concat(name, F.lit(".txt"))).withColumn("bytes", F.octet_length("text").cast("bigint"))
    named = named.withColumn("hits", D.all_hits(F.col("text"), S.UPLOAD_RULES))
    too_big = F.col("bytes") > S.MAX_UPLOAD_BYTES
    prompt = validate.native_prompt(F.col("name"), F.col("text"))
    return named.select(
        "doc_id", "name", "bytes",
        F.when(too_big, 413).when(F.size("hits") > 0, 400).otherwise(200).cast("bigint").alias("http_status"),
        F.when(too_big, S.ERROR).when(F.size("hits") > 0, S.BLOCKED).otherwise(S.ALLOWED).alias("verdict"),
        F.when(too_big, "none").otherwise(D.names_or_none(F.col("hits"))).alias("filters"),
        validate.native_skip(F.col("text"), prompt).isNull().alias("native_sent"),
    )


def _page_text_sql():
    text = replace_all_sql("html", [(p, "chr(10)" if to == "\n" else quote(to)) for p, to in pages.STEPS])
    for entity, char in pages.ENTITIES:
        text = f"replace({text}, {quote(entity)}, {quote(char)})"
    return normalize_sql(text)


_PAGES = f"SELECT page_id, {_page_text_sql()} AS text FROM pages"


@query(f"""
SELECT page_id, text, length(text) AS n_chars, left(text, {S.PREVIEW_CHARS}) AS preview,
       length(text) > {S.PREVIEW_CHARS} AS truncated,
       '<prompt, ' || format('{{:,}}', length(text)) || ' chars>' AS described
FROM ({_PAGES})
""")
def extract_pages(spark, folder):
    found = pages.extract_pages(spread(read_table(spark, folder, "pages").select("page_id", "html"), "page_id"))
    return found.select(
        "page_id", "text", F.length("text").cast("bigint").alias("n_chars"), "preview", "truncated",
        X.describe_prompt(F.length("text")).alias("described"),
    )


_BAD_LINK = quote(dict(S.PROMPT_RULES)["malicious_uris"])


@query(f"""
SELECT page_id, verdict, filters, n_hits, n_bad_links
FROM {screened_sql(f"(SELECT *, CAST(len(regexp_extract_all(text, {_BAD_LINK})) AS BIGINT) AS n_bad_links FROM ({_PAGES}))",
                   'page_id, n_bad_links')}
""")
def screen_pages(spark, folder):
    text = pages.extract_pages(spread(read_table(spark, folder, "pages").select("page_id", "html"), "page_id"))
    return D.screen(text.select("page_id", "text")).select(
        "page_id", "verdict", D.names_or_none(F.col("hits")).alias("filters"),
        F.size("hits").cast("bigint").alias("n_hits"),
        F.size(D.bad_links(F.col("text"))).cast("bigint").alias("n_bad_links"),
    )


@F.pandas_udf(T.BinaryType())
def _written_pdf(texts: pd.Series) -> pd.Series:
    """Texts as PDF files: pages of ten lines in compressed streams, the page tree in an object
    stream, and one font whose codes only its character map explains."""

    def one(text):
        chars = sorted(set(text) - {"\n"})
        code = {c: "%04X" % i for i, c in enumerate(chars, 1)}
        shown = {**code, "\n": "> Tj T* <"}
        lines = text.split("\n")
        pages = [lines[i : i + 10] for i in range(0, len(lines), 10)]
        char_map = b"%d beginbfchar\n%s\nendbfchar" % (
            len(chars), b"\n".join(b"<%s> <%s>" % (code[c].encode(), c.encode("utf-16-be").hex().encode()) for c in chars)
        )
        streams = {5: char_map}
        packed = {1: b"<</Type/Catalog/Pages 2 0 R>>", 4: b"<</Type/Font/ToUnicode 5 0 R>>"}
        packed[2] = b"<</Type/Pages/Resources<</Font<</F1 4 0 R>>>>/Kids[%s]>>" % b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
        for i, page in enumerate(pages):
            packed[10 + 2 * i] = b"<</Type/Page/Contents %d 0 R>>" % (11 + 2 * i)
            lines_shown = "".join(map(shown.__getitem__, "\n".join(page)))
            streams[11 + 2 * i] = b"BT /F1 11 Tf 50 700 Td <%s> Tj T* ET" % lines_shown.encode()
        index, body = b"", b""
        for number, value in packed.items():
            index += b"%d %d " % (number, len(body))
            body += value + b" "
        pieces = [b"%PDF-1.7"]
        for number, data in [(3, index + body), *streams.items()]:
            head = b"/Type/ObjStm/N %d/First %d" % (len(packed), len(index)) if number == 3 else b""
            data = zlib.compress(data, 1)
            pieces.append(b"%d 0 obj\n<<%s/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream\nendobj" % (number, head, len(data), data))
        return b"\n".join([*pieces, b"%%EOF"])

    return texts.map(lambda t: None if t is None else one(t))


@query(f"""
WITH f AS (
  SELECT doc_id, n_chars % 2 = 0 AS pdf, n_chars % 13 = 1 AS broken, {normalize_sql('text')} AS pdf_text,
         regexp_replace(regexp_replace(text, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '') AS plain FROM documents),
t AS (SELECT doc_id, CASE WHEN pdf THEN pdf_text WHEN broken THEN '' ELSE plain END AS text,
             CASE WHEN broken AND NOT pdf THEN 'Text files must be UTF-8' ELSE 'none' END AS note FROM f)
SELECT doc_id, text, note,
       CASE WHEN verdict <> 'blocked' AND (text = '' OR note <> 'none') THEN 'incomplete' ELSE verdict END AS verdict, filters
FROM {screened_sql('t', 'doc_id, text, note')}
""")
def extract_documents(spark, folder):
    """Documents written as PDF or text files, read back from their bytes, then screened."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    is_pdf = F.col("n_chars") % 2 == 0
    plain = F.concat(F.unhex(F.when(F.col("n_chars") % 13 == 1, "FF").otherwise("EFBBBF")), F.encode("text", "UTF-8"))
    written = X.computed_once(docs.withColumn("pdf", _written_pdf(F.when(is_pdf, F.col("text")))), "pdf")
    files = written.select(
        "doc_id",
        F.concat(F.lit("file-"), "doc_id", F.when(is_pdf, ".pdf").otherwise(".txt")).alias("name"),
        F.when(is_pdf, F.col("pdf")).otherwise(plain).alias("content"),
    )
    # No text means there was nothing to screen, which is not the same as clean.
    texts = documents_text.extract_documents(files)
    screened = D.screen(texts.withColumn("screened", F.nullif("text", F.lit(""))), "screened")
    return screened.select(
        "doc_id", "text", F.coalesce("note", F.lit("none")).alias("note"),
        documents_text.document_verdict(F.col("verdict"), F.col("text"), F.col("note")).alias("verdict"),
        D.names_or_none(F.col("hits")).alias("filters"),
    )


# --- screening results -------------------------------------------------------------

# German documents come back with one required filter not run.
_SKIPPED = "lang = 'de'"


def _results(spark, folder):
    docs = documents(spark, folder, columns=("text", "lang"))
    hits = docs.select("doc_id", "lang", D.all_hits(F.col("text")).alias("hits"), (F.length("text") > S.MAX_TEXT_CHARS).alias("over"))
    skipped = F.when(F.col("lang") == "de", F.array(F.lit("sdp"))).otherwise(X.empty_strings())
    return hits.select("doc_id", R.emulate_result(F.col("hits"), F.col("over"), skipped).alias("result"))


_RESULT_ROWS = f"""
  SELECT doc_id, lang, n_text > {S.MAX_TEXT_CHARS} AS over_limit,
         CASE WHEN n_text > {S.MAX_TEXT_CHARS} THEN 0 ELSE n_hits END AS n,
         CASE WHEN n_text > {S.MAX_TEXT_CHARS} THEN 'none' ELSE filters END AS f
  FROM {screened_sql('docs', 'doc_id, lang')}"""


# A result lists its filters in its own order.
_RESULT_ORDER = [("malicious_uris", 1), ("rai:harassment", 2), ("pi_and_jailbreak", 0), ("sdp", 3)]
_BY_RESULT_ORDER = [S.PROMPT_RULES[i] for _, i in _RESULT_ORDER]


@query(f"""
WITH {docs_sql()}, r AS ({_RESULT_ROWS.replace(filters_sql('text'), filters_sql('text', _BY_RESULT_ORDER))})
SELECT doc_id,
       CASE WHEN n > 0 THEN 'blocked' WHEN over_limit OR {_SKIPPED} THEN 'incomplete' ELSE 'allowed' END AS verdict,
       f AS filters,
       CASE WHEN over_limit THEN 'FAILURE' ELSE 'SUCCESS' END AS invocation,
       NOT (over_limit OR {_SKIPPED}) AS complete,
       CASE WHEN n > 0 THEN 'blocked' WHEN over_limit OR {_SKIPPED} THEN 'incomplete' ELSE 'allowed' END AS text_verdict
FROM r
""")
def verdict_from_results(spark, folder):
    rows = R.summarize(_results(spark, folder), "result")
    rows = R.summarize_text(rows, "result", prefix="text_")
    return rows.select(
        "doc_id", "verdict", D.names_or_none(F.col("filters")).alias("filters"), "invocation", "complete", "text_verdict"
    )


@query(f"""
WITH {docs_sql()}, r AS ({_RESULT_ROWS}),
f(filter, label) AS (VALUES ('csam', 'csam'), ('malicious_uris', 'malicious_uris'), ('rai', 'rai:harassment'),
                            ('pi_and_jailbreak', 'pi_and_jailbreak'), ('sdp', 'sdp'))
SELECT doc_id, filter,
       CASE WHEN over_limit OR (filter = 'sdp' AND {_SKIPPED}) THEN 'EXECUTION_SKIPPED' ELSE 'EXECUTION_SUCCESS' END
         AS execution_state,
       CASE WHEN list_contains(string_split(f, ','), label) THEN 'MATCH_FOUND' ELSE 'NO_MATCH_FOUND' END AS match_state,
       CASE WHEN list_contains(string_split(f, ','), label) THEN label ELSE 'none' END AS names
FROM r, f
""")
def filter_results(spark, folder):
    rows = R.explode_filters(_results(spark, folder), "result", keep=("doc_id",))
    return rows.withColumn("names", F.coalesce(F.array_join("names", ","), F.lit("none")))


@query(f"""
WITH {docs_sql()}, r AS ({_RESULT_ROWS})
SELECT doc_id,
       CASE WHEN n > 0 THEN 'MATCH_FOUND' ELSE 'NO_MATCH_FOUND' END AS match_state,
       CASE WHEN over_limit THEN 'FAILURE' ELSE 'SUCCESS' END AS invocation,
       CASE WHEN list_contains(string_split(f, ','), 'rai:harassment') THEN 'MATCH_FOUND' ELSE 'NO_MATCH_FOUND' END AS rai_state,
       CASE WHEN list_contains(string_split(f, ','), 'pi_and_jailbreak') THEN 'MATCH_FOUND' ELSE 'NO_MATCH_FOUND' END
         AS pi_and_jailbreak_state,
       CASE WHEN list_contains(string_split(f, ','), 'malicious_uris') THEN 'MATCH_FOUND' ELSE 'NO_MATCH_FOUND' END
         AS malicious_uris_state,
       CASE WHEN list_contains(string_split(f, ','), 'sdp') THEN 'MATCH_FOUND' ELSE 'NO_MATCH_FOUND' END AS sdp_state
FROM r
""")
def result_fields(spark, folder):
    return _results(spark, folder).select("doc_id", *R.extract_fields(F.col("result")))


@query(f"""
WITH {docs_sql()}, r AS ({_RESULT_ROWS})
SELECT doc_id,
       CASE WHEN n > 0 THEN 'blocked' WHEN over_limit OR {_SKIPPED} THEN 'incomplete' ELSE 'allowed' END AS strict,
       CASE WHEN n > 0 THEN 'blocked' WHEN over_limit THEN 'incomplete' ELSE 'allowed' END AS legacy,
       n = 0 AND NOT over_limit AND {_SKIPPED} AS let_through
FROM r
""")
def legacy_vs_strict(spark, folder):
    rows = R.summarize(_results(spark, folder), "result").withColumn("legacy", R.simple_verdict(F.col("result")))
    return rows.select(
        "doc_id", F.col("verdict").alias("strict"), "legacy",
        ((F.col("legacy") == S.ALLOWED) & (F.col("verdict") != S.ALLOWED)).alias("let_through"),
    )


# --- both modes ------------------------------------------------------------------------


@query(f"""
WITH {docs_sql()}, named AS (SELECT *, source || '-' || doc_id || '.txt' AS name FROM docs),
s AS {screened_sql(f"(SELECT *, length({_UPLOAD_PROMPT}) AS native_chars FROM named)",
                   'doc_id, native_chars', limit=S.MAX_UPLOAD_BYTES)}
SELECT doc_id, native_chars, native_chars > {S.MAX_TEXT_CHARS} AS skipped,
       CASE WHEN native_chars > {S.MAX_TEXT_CHARS} THEN 'error' ELSE verdict END AS native_verdict,
       CASE WHEN verdict = 'allowed' THEN 'unsupported' ELSE verdict END AS native_with_file,
       verdict AS callout_verdict,
       CASE WHEN native_chars > {S.MAX_TEXT_CHARS} THEN 'mixed' ELSE verdict END AS combined
FROM s
""")
def native_vs_callout_docs(spark, folder):
    docs = documents(spark, folder, columns=("text", "source"))
    docs = docs.withColumn("name", F.concat(F.concat_ws("-", "source", "doc_id"), F.lit(".txt")))
    docs = docs.withColumn("prompt", validate.native_prompt(F.col("name"), F.col("text")))
    docs = docs.withColumn("skipped", validate.native_skip(F.col("text"), F.col("prompt")).isNotNull())
    # The file itself is screened whole; only the text mode has the small limit.
    docs = D.screen(docs, max_chars=S.MAX_UPLOAD_BYTES)
    docs = docs.withColumn("native", F.when(F.col("skipped"), S.ERROR).otherwise(F.col("verdict")))
    return docs.select(
        "doc_id", F.length("prompt").cast("bigint").alias("native_chars"), "skipped", F.col("native").alias("native_verdict"),
        V.native_prompt_verdict(F.col("verdict"), F.lit(1), F.lit("chat")).alias("native_with_file"),
        F.col("verdict").alias("callout_verdict"),
        V.combine_modes(F.col("native"), F.col("verdict")).alias("combined"),
    )


@query(f"""
WITH {docs_sql()},
n AS {screened_sql('docs', 'doc_id, n_chars')},
c AS {screened_sql('docs', 'doc_id', rules=S.UPLOAD_RULES, limit=S.MAX_UPLOAD_BYTES)}
SELECT doc_id, n.verdict AS native_verdict, c.verdict AS callout_verdict, n.verdict = c.verdict AS same_verdict,
       n.verdict = 'blocked' AND c.verdict = 'blocked'
         AND list_sort(list_transform(string_split(n.filters, ','), lambda x: split_part(x, ':', 1)))
          <> list_sort(list_transform(string_split(c.filters, ','), lambda x: split_part(x, ':', 1))) AS filters_differ,
       CASE WHEN n.verdict = c.verdict AND n.verdict IN ('blocked', 'allowed') THEN n.verdict ELSE 'mixed' END AS combined,
       CAST(CASE WHEN n_chars % 90 > 0 THEN 20 + n_chars % 40 ELSE -1 END AS BIGINT) AS latency_delta
FROM n JOIN c USING (doc_id)
""")
def compare_modes(spark, folder):
    docs = documents(spark, folder, columns=("text", "n_chars"))
    native_ms = F.col("n_chars") % 90
    modes = docs.select(
        "doc_id",
        F.inline(F.array(
            F.struct(
                F.lit("native").alias("mode"), D.all_hits(F.col("text")).alias("filters"),
                F.lit(S.MAX_TEXT_CHARS).alias("limit"), native_ms.alias("latency_ms"),
            ),
            F.struct(
                F.lit("callout").alias("mode"), D.all_hits(F.col("text"), S.UPLOAD_RULES).alias("filters"),
                F.lit(S.MAX_UPLOAD_BYTES).alias("limit"), (native_ms + 20 + F.col("n_chars") % 40).alias("latency_ms"),
            ),
        )),
        F.length("text").alias("chars"),
    )
    # Names and numbers only from here on: the text does not travel to the pairing.
    verdict = (
        F.when(F.size("filters") > 0, S.BLOCKED).when(F.col("chars") > F.col("limit"), S.INCOMPLETE).otherwise(S.ALLOWED)
    )
    rows = modes.select("doc_id", "mode", "filters", "latency_ms", verdict.alias("verdict"))
    return compare.compare_modes(rows, ["doc_id"]).withColumn("latency_delta", or_minus_one("latency_delta"))


@query(f"""
WITH {docs_sql()}, s AS {screened_sql('docs', 'doc_id')}
SELECT doc_id, verdict,
       CASE WHEN filters LIKE '%rai:%' THEN 'hit' WHEN verdict <> 'incomplete' THEN 'pass' ELSE 'unknown' END AS rai,
       CASE WHEN filters LIKE '%pi_and_jailbreak%' THEN 'hit' WHEN verdict <> 'incomplete' THEN 'pass' ELSE 'unknown' END
         AS pi_and_jailbreak,
       CASE WHEN filters LIKE '%malicious_uris%' THEN 'hit' WHEN verdict <> 'incomplete' THEN 'pass' ELSE 'unknown' END
         AS malicious_uris,
       CASE WHEN filters LIKE '%sdp%' THEN 'hit' WHEN verdict <> 'incomplete' THEN 'pass' ELSE 'unknown' END AS sdp
FROM s
""")
def filter_matrix(spark, folder):
    docs = D.screen(documents(spark, folder, columns=("text",)))
    return docs.select("doc_id", "verdict", *V.filter_chips(F.col("verdict"), F.col("hits")))


@query(f"""
WITH {docs_sql()}, h AS (
  SELECT lang, unnest(string_split(filters, ',')) AS filter FROM {screened_sql('docs', 'lang')} WHERE filters <> 'none')
SELECT coalesce(lang, 'all') AS lang, coalesce(filter, 'all') AS filter, count(*) AS n_hits,
       CAST(grouping(lang, filter) AS BIGINT) AS level
FROM h GROUP BY ROLLUP (lang, filter)
""")
def hits_rollup(spark, folder):
    docs = documents(spark, folder, columns=("text", "lang"))
    rows = docs.select("lang", D.all_hits(F.col("text")).alias("filters"))
    totals = compare.hits_rollup(rows)
    return totals.withColumn("lang", F.coalesce("lang", F.lit("all"))).withColumn("filter", F.coalesce("filter", F.lit("all")))


# --- sensitive data ----------------------------------------------------------------------

_COUNTS = " UNION ALL ".join(
    f"SELECT doc_id, {quote(n)} AS info_type, CAST(len(regexp_extract_all(text, {quote(p)})) AS BIGINT) AS n FROM docs"
    for n, p in S.INFO_TYPES
)
_ALL_SEEDS = SEEDS + TYPE_SEEDS


@query(f"WITH {docs_sql(_ALL_SEEDS)} SELECT * FROM ({_COUNTS}) WHERE n > 0")
def pii_findings(spark, folder):
    return D.findings(documents(spark, folder, _ALL_SEEDS, columns=("text",)), keep=("doc_id",))


@query(f"""
WITH {docs_sql(_ALL_SEEDS)}, c AS (
  SELECT *, CASE WHEN n > 2 THEN 'HIGH' WHEN n > 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ({_COUNTS}) WHERE n > 0)
SELECT doc_id, info_type, confidence, confidence <> 'LOW' AS kept FROM c
""")
def threshold_findings(spark, folder):
    # The rules know no likelihood, so repetition stands in for it.
    found = D.findings(documents(spark, folder, _ALL_SEEDS, columns=("text",)), keep=("doc_id",))
    found = found.withColumn("confidence", F.when(F.col("n") > 2, "HIGH").when(F.col("n") > 1, "MEDIUM").otherwise("LOW"))
    return found.select(
        "doc_id", "info_type", "confidence", D.above_threshold(F.col("info_type"), F.col("confidence")).alias("kept")
    )


@query(f"""
WITH {docs_sql(_ALL_SEEDS)}
SELECT doc_id, {replace_all_sql('text', [(p, quote(f'[{n}]')) for n, p in S.INFO_TYPES])} AS redacted FROM docs
""")
def redact_documents(spark, folder):
    docs = documents(spark, folder, _ALL_SEEDS, columns=("text",))
    return docs.select("doc_id", D.redact_text(F.col("text")).alias("redacted"))


_RULE_VALUES = ", ".join(f"({i}, {quote(n)}, {quote(p)})" for i, (n, p) in enumerate(S.PROMPT_RULES))


@query(f"""
WITH {docs_sql()}, rules(rule_order, filter, pattern) AS (VALUES {_RULE_VALUES})
SELECT doc_id, CAST(rule_order AS BIGINT) AS rule_order, filter FROM docs JOIN rules ON regexp_matches(text, pattern)
""")
def rule_table_join(spark, folder):
    rules = [(i, n, p) for i, (n, p) in enumerate(S.PROMPT_RULES)]
    docs = documents(spark, folder, columns=("text",))
    return compare.match_rules(docs, rules, keep=("doc_id",))


# --- expectations ----------------------------------------------------------------------------

_IDS = [s[0] for s in S.SCENARIOS]
_CARRIERS = ", ".join(
    f"({i}, {quote(s[0])}, {quote(s[1])}, {quote(s[2]) if s[2] else 'NULL'}, {quote(s[3])})" for i, s in enumerate(S.SCENARIOS)
)


@query(f"""
WITH sc(i, scenario_id, expect, wanted, prompt) AS (VALUES {_CARRIERS}),
carried AS (SELECT scenario_id, expect, wanted, text || chr(10) || prompt AS text
            FROM documents JOIN sc ON doc_id % {len(_IDS)} = i),
s AS {screened_sql('carried', 'scenario_id, expect, wanted')}
SELECT scenario_id, count(*) AS n, count(*) FILTER (verdict = expect) AS n_verdict_ok,
       count(*) FILTER (wanted IS NULL OR verdict <> 'blocked' OR filters LIKE '%' || split_part(wanted, ':', 1) || '%')
         AS n_filter_ok,
       bool_and(verdict = expect AND (wanted IS NULL OR verdict <> 'blocked'
                OR filters LIKE '%' || split_part(wanted, ':', 1) || '%')) AS passed
FROM s GROUP BY scenario_id
""")
def scenario_check(spark, folder):
    """Every document carries one scenario's prompt at its end; does the screener still see it?"""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    sid = F.get(F.array(*[F.lit(i) for i in _IDS]), (F.col("doc_id") % len(_IDS)).cast("int"))
    carried = docs.withColumn("scenario_id", sid).withColumn(
        "text", F.concat("text", F.lit("\n"), X.lookup({s[0]: s[3] for s in S.SCENARIOS}, F.col("scenario_id")))
    )
    screened = D.screen(carried).withColumnRenamed("hits", "filters")
    # The verdict a client sees comes back through the status of the answer.
    answer = V.outcome_status(F.col("verdict"))
    seen = screened.withColumn("status", answer).withColumn(
        "verdict", V.strict_status_verdict(F.col("status.http_status"), F.col("status.code"))
    )
    return compare.scenario_check(seen.select("scenario_id", "verdict", "filters"))


@query(f"""
WITH s AS {screened_sql('documents', 'doc_id')},
j AS (SELECT toxic = 1 AS toxic, filters LIKE '%rai:%' AS rai, quality = 0 AS poor, verdict <> 'allowed' AS stopped
      FROM s JOIN labels USING (doc_id)),
c AS (
  SELECT 'toxic' AS label, count(*) FILTER (toxic AND rai) AS tp, count(*) FILTER (NOT toxic AND rai) AS fp,
         count(*) FILTER (toxic AND NOT rai) AS fn, count(*) FILTER (NOT toxic AND NOT rai) AS tn FROM j
  UNION ALL
  SELECT 'poor', count(*) FILTER (poor AND stopped), count(*) FILTER (NOT poor AND stopped),
         count(*) FILTER (poor AND NOT stopped), count(*) FILTER (NOT poor AND NOT stopped) FROM j)
SELECT label, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM c
""")
def label_confusion(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    screened = D.screen(docs).select(
        "doc_id", F.exists("hits", lambda h: X.base_filter(h) == "rai").alias("rai"), (F.col("verdict") != S.ALLOWED).alias("stopped")
    )
    labelled = screened.join(read_table(spark, folder, "labels"), "doc_id")
    return compare.confusion(labelled, [
        ("toxic", F.col("toxic") == 1, F.col("rai")), ("poor", F.col("quality") == 0, F.col("stopped")),
    ])
