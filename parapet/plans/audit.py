"""Queries over the audit ledger and the event log."""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import detect as D, scalars as X
from parapet.operators import ledger as L, ordered, verdicts as V
from parapet.plans.common import docs_sql, documents, or_minus_one, query, screened_sql
from parapet.sources.readers import read_table, spread

# --- ledger built from screened documents -------------------------------------------

_STATUSES = {S.ALLOWED: 200, S.BLOCKED: 400, S.INCOMPLETE: 503}


def _ledger(spark, folder):
    docs = D.screen(documents(spark, folder, columns=("text", "source", "lang", "n_chars")))
    status = X.lookup(_STATUSES, F.col("verdict"))
    rows = docs.withColumn("http_status", status)
    return rows.select(
        F.concat(F.lit("ui-"), "doc_id").alias("id"),
        F.when(F.col("lang") != "es", F.timestamp_add("MINUTE", F.col("doc_id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))).alias("ts"),
        X.clean_label(F.concat(F.lit("doc/"), "source"), 64).alias("scenario_id"),
        F.when(F.col("n_chars") % 2 == 0, "native").otherwise("callout").alias("mode"),
        F.nullif(F.array_join("hits", ","), F.lit("")).alias("filters"),
        "http_status",
        V.status_verdict(F.col("http_status")).alias("verdict"),
        F.nullif(F.col("n_chars") % 97, F.lit(0).cast("bigint")).cast("int").alias("latency_ms"),
        F.lit("ui").alias("source"),
        F.concat(F.lit("req-"), "doc_id").alias("request_id"),
    )


_LEDGER = f"""
  {docs_sql()}, ledger AS (
  SELECT doc_id, 'ui-' || doc_id AS id,
         CASE WHEN lang <> 'es' THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) END AS ts,
         'doc' || source AS scenario_id, CASE WHEN n_chars % 2 = 0 THEN 'native' ELSE 'callout' END AS mode,
         nullif(filters, 'none') AS filters,
         CASE verdict WHEN 'allowed' THEN 200 WHEN 'blocked' THEN 400 ELSE 503 END AS http_status,
         CASE verdict WHEN 'incomplete' THEN 'error' ELSE verdict END AS verdict,
         nullif(n_chars % 97, 0) AS latency_ms, 'ui' AS source, 'req-' || doc_id AS request_id
  FROM {screened_sql('docs', 'doc_id, lang, source, n_chars')})"""
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_ts = lambda c="ts": F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("ts")
_long = lambda c: F.col(c).cast("bigint").alias(c)


@query(f"""
WITH {_LEDGER}
SELECT request_id, scenario_id, 'mm-' || mode AS mode, 'text' AS input, verdict AS caller_verdict,
       CASE verdict WHEN 'error' THEN 'incomplete' ELSE verdict END AS multipart_verdict,
       CASE verdict WHEN 'error' THEN 'error' ELSE verdict END AS ledger_verdict,
       coalesce(filters, 'none') AS filters, CAST(http_status AS BIGINT) AS http_status,
       CAST(coalesce(latency_ms, -1) AS BIGINT) AS latency_ms,
       CASE WHEN verdict = 'error' THEN 'error' WHEN http_status = 400 THEN 'error' ELSE 'allowed' END AS rejected_verdict
FROM ledger
""")
def audit_messages(spark, folder):
    """Log records, with the telemetry read back from the headers a caller would get."""
    rows = _ledger(spark, folder)
    header = F.create_map(
        F.lit("x-mode"), F.concat(F.lit("mm-"), "mode"),
        F.lit("x-filters"), F.coalesce("filters", F.lit("none")),
        F.lit("x-latency-ms"), F.coalesce(F.col("latency_ms").cast("string"), F.lit("0")),
        F.lit("x-input"), F.lit("text"),
    )
    rows = rows.withColumn("t", L.telemetry(header, F.lit(None).cast("string"), F.col("mode")))
    multipart = V.multipart_status_verdict(F.col("http_status"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return L.audit_message(
        rows,
        request_id=F.col("request_id"), scenario_id=F.col("scenario_id"), mode=F.col("t.mode"), input=F.col("t.input"),
        caller_verdict=V.status_verdict(F.col("http_status")), multipart_verdict=multipart,
        ledger_verdict=V.ledger_verdict(multipart), filters=D.names_or_none(F.col("t.filters")),
        http_status=F.col("http_status").cast("bigint"), latency_ms=or_minus_one("t.latency_ms"),
        rejected_verdict=V.status_verdict(F.col("http_status"), F.when(F.col("http_status") == 400, "INVALID_ARGUMENT")),
    )


_KPIS = """count(*) AS total, count(*) FILTER (verdict = 'allowed') AS allowed,
       count(*) FILTER (verdict <> 'allowed') AS blocked,
       CAST(floor(count(*) FILTER (verdict <> 'allowed') * 100.0 / count(*) + 0.5) AS BIGINT) AS block_rate,
       round(avg(coalesce(latency_ms, 0)), 6) AS mean_latency_ms"""


@query(f"WITH {_LEDGER} SELECT {_KPIS} FROM ledger")
def audit_kpis(spark, folder):
    return L.kpis(_ledger(spark, folder)).withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))


@query(f"WITH {_LEDGER} SELECT mode, {_KPIS} FROM ledger GROUP BY mode")
def audit_kpis_by_mode(spark, folder):
    return L.kpis(_ledger(spark, folder), "mode").withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))


@query(f"""
WITH {_LEDGER}
SELECT id, scenario_id, mode, coalesce(filters, '') AS filters, verdict, CAST(http_status AS BIGINT) AS http_status FROM ledger
WHERE contains(lower(scenario_id || ' ' || mode || ' ' || coalesce(filters, '') || ' ' || verdict || ' ' || http_status),
               'native rai:harassment')
""")
def audit_search(spark, folder):
    found = L.search(_ledger(spark, folder), " NATIVE rai:Harassment ")
    return found.select("id", "scenario_id", "mode", F.coalesce("filters", F.lit("")).alias("filters"), "verdict", _long("http_status"))


_PUBLIC = "scenario_id, mode, coalesce(filters, 'none') AS filters, CAST(http_status AS BIGINT) AS http_status, verdict, " \
          "CAST(coalesce(latency_ms, 0) AS BIGINT) AS latency_ms, source"


@query(f"""
WITH {_LEDGER}, r AS (SELECT *, row_number() OVER (ORDER BY ts DESC NULLS LAST, id) AS rank FROM ledger)
SELECT {_TS} AS ts, {_PUBLIC}, rank, rank <= {S.LEDGER_PAGE} AS on_first_page FROM r WHERE rank <= {S.LEDGER_KEEP}
""")
def audit_retention(spark, folder):
    """The newest rows the ledger keeps, public columns only."""
    kept = L.ranked(_ledger(spark, folder))
    return kept.select(
        _ts(), "scenario_id", "mode", F.coalesce("filters", F.lit("none")).alias("filters"), _long("http_status"), "verdict",
        F.coalesce("latency_ms", F.lit(0)).cast("bigint").alias("latency_ms"), "source", _long("rank"),
        (F.col("rank") <= S.LEDGER_PAGE).alias("on_first_page"),
    )


# --- merging an outside log -----------------------------------------------------------------

_EVENT_STATUS = {"view": "200", "click": "200", "purchase": "400", "signup": "503", "error": "oops"}


def _log_entries(spark, folder):
    """Every event as an entry of an outside log; entries of k = 0 lost their id."""
    events = spread(read_table(spark, folder, "events"), "event_id")
    k = F.get_json_object("props", "$.k")
    payload = F.to_json(F.struct(
        F.concat(F.lit("user/"), "user_id").alias("scenarioId"),
        F.lit("callout").alias("mode"),
        F.col("event_type").alias("filters"),
        F.round(F.col("value")).cast("bigint").cast("string").alias("latencyMs"),
        X.lookup(_EVENT_STATUS, F.col("event_type")).alias("httpStatus"),
        F.concat_ws("-", F.lit("req"), "user_id", k).alias("requestId"),
    ))
    entries = events.select(
        F.when(k != "0", F.concat(F.lit("ev-"), "event_id")).alias("insertId"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        payload.alias("jsonPayload"),
        "event_type", "event_id",
    )
    # Written before it is read: inside the reader's expression it would not be compiled.
    return X.computed_once(entries, "jsonPayload")


def parsed_events(spark, folder):
    """Every event as a ledger row taken from the log, with its own columns beside it."""
    return L.from_log(_log_entries(spark, folder), keep=("event_type", "event_id"))


def local_and_log(parsed):
    """Purchases were recorded by the gateway itself, sign-ups were merged from the log before."""
    log = parsed.drop("event_type", "event_id")
    own = F.col("event_type") == "purchase"
    local = parsed.where("event_type in ('purchase', 'signup')").withColumns({
        "id": F.when(own, F.concat(F.lit("ui-"), "event_id")).otherwise(F.col("id")),
        "source": F.when(own, "ui").otherwise(F.col("source")),
    })
    return local.select(log.columns), log


LOG_SQL = """
  entry AS (
    SELECT event_id, event_type, ts, json_extract_string(props, '$.k') AS k, 'user' || user_id AS scenario_id,
           CAST(round(value) AS BIGINT) AS ms,
           CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'purchase' THEN 400 WHEN 'signup' THEN 503 ELSE 0 END
             AS http_status, user_id FROM events),
  log AS (
    SELECT CASE WHEN k <> '0' THEN 'ev-' || event_id END AS id, ts, scenario_id, event_type AS filters, http_status,
           CASE http_status WHEN 200 THEN 'allowed' WHEN 400 THEN 'blocked' ELSE 'error' END AS verdict,
           nullif(ms, 0) AS latency_ms, 'external-log' AS source, 'req-' || user_id || '-' || k AS request_id,
           event_id, event_type FROM entry),
  local AS (
    SELECT * REPLACE ('ui-' || event_id AS id, 'ui' AS source) FROM log WHERE event_type = 'purchase'
    UNION ALL SELECT * FROM log WHERE event_type = 'signup'),
  fresh AS (
    SELECT * FROM log WHERE id IS NOT NULL
      AND id NOT IN (SELECT id FROM local WHERE id IS NOT NULL)
      AND request_id NOT IN (SELECT request_id FROM local WHERE source <> 'external-log'))"""
MERGED_COLUMNS_SQL = f"""coalesce(id, 'none') AS id, {_TS} AS ts, scenario_id, filters, CAST(http_status AS BIGINT) AS http_status,
       verdict, CAST(coalesce(latency_ms, 0) AS BIGINT) AS latency_ms, source, request_id"""


def merged_columns(df):
    return df.select(
        F.coalesce("id", F.lit("none")).alias("id"), _ts(), "scenario_id", "filters", _long("http_status"), "verdict",
        F.coalesce("latency_ms", F.lit(0)).cast("bigint").alias("latency_ms"), "source", "request_id",
    )


@query(f"WITH {LOG_SQL} SELECT {MERGED_COLUMNS_SQL} FROM (SELECT * FROM local UNION ALL SELECT * FROM fresh)")
def audit_sync_events(spark, folder):
    """The whole log merged into the whole ledger."""
    return merged_columns(L.merge_log(*local_and_log(parsed_events(spark, folder))))


_PULLED = LOG_SQL.replace(
    "FROM log WHERE id IS NOT NULL",
    f"FROM (SELECT * FROM log ORDER BY ts DESC, id LIMIT {S.LOG_PULL}) WHERE id IS NOT NULL",
)


@query(f"""
WITH {_PULLED}, kept AS (
  SELECT * FROM (SELECT * FROM local UNION ALL SELECT * FROM fresh) ORDER BY ts DESC, id LIMIT {S.LEDGER_KEEP})
SELECT {MERGED_COLUMNS_SQL} FROM kept
""")
def audit_sync_newest(spark, folder):
    """A refresh: the newest 30 log entries, then the newest 500 rows kept."""
    local, log = local_and_log(parsed_events(spark, folder))
    return merged_columns(L.newest(L.merge_log(local, log, pull=S.LOG_PULL)))


# --- events in time -------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000 END AS t FROM events),
p AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e)
SELECT user_id, event_id, CASE WHEN t >= prev THEN t - prev ELSE -1 END AS ms FROM p
""")
def turn_latency(spark, folder):
    """Time between the steps of a user; the time of an error is not known."""
    events = spread(read_table(spark, folder, "events"), "event_id").select("user_id", "event_id", "event_type", "ts")
    at = F.floor(X.epoch_micros(F.col("ts")) / 1000).cast("bigint")
    steps = events.select("user_id", "event_id", F.when(F.col("event_type") != "error", at).alias("t"))
    return ordered.part_latency(steps, ["user_id"], "event_id", "t").select("user_id", "event_id", or_minus_one("ms"))


def _event_kpis(*by):
    return [*by, F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"),
            F.round(F.sum("value"), 2).alias("total_value")]


_EVENT_AGGS = "count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors, round(sum(value), 2) AS total_value"
_FMT = "yyyy-MM-dd HH:mm:ss"
_SQL_FMT = "'%Y-%m-%d %H:%M:%S'"


def windowed(df, *args):
    """Figures per event-time window, for a table or a stream alike."""
    grouped = df.groupBy(F.window("ts", *args)).agg(*_event_kpis())
    return grouped.select(F.date_format("window.start", _FMT).alias("window_start"), "n_events", "n_errors", "total_value")


@query(f"""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {_SQL_FMT}) AS window_start, {_EVENT_AGGS}
FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts)
""")
def events_tumbling(spark, folder):
    return windowed(spread(read_table(spark, folder, "events"), "event_id").select("ts", "event_type", "value"), "1 hour")


@query(f"""
WITH s AS (
  SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * i) AS w, * FROM events, range(2) AS r(i))
SELECT strftime(w, {_SQL_FMT}) AS window_start, {_EVENT_AGGS} FROM s GROUP BY w
""")
def events_sliding(spark, folder):
    return windowed(spread(read_table(spark, folder, "events"), "event_id").select("ts", "event_type", "value"), "1 hour", "30 minutes")


_GAP = 30 * 60 * 1_000_000


@query(f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {_GAP} THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS sid FROM g)
SELECT user_id, min(t) AS session_start, max(t) + {_GAP} AS session_end, count(*) AS n_events FROM s GROUP BY user_id, sid
""")
def events_session(spark, folder):
    events = spread(read_table(spark, folder, "events"), "event_id").select("user_id", X.epoch_micros(F.col("ts")).alias("at"))
    return ordered.sessions(events, "user_id", "at", _GAP)


_WAIT = S.RESULT_WAIT_SECONDS * 60 * 1_000_000


@query(f"""
WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
r AS (SELECT event_id AS result_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
m AS (SELECT p.event_id, min(r.t) AS at, arg_min(r.result_id, r.t) AS result_id
      FROM p JOIN r ON p.user_id = r.user_id AND r.t >= p.t AND r.t <= p.t + {_WAIT} GROUP BY p.event_id)
SELECT p.event_id, p.user_id, coalesce(m.result_id, -1) AS result_id, coalesce(m.at - p.t, -1) AS waited,
       CASE WHEN m.at IS NULL THEN 'incomplete' ELSE 'allowed' END AS verdict
FROM p LEFT JOIN m USING (event_id)
""")
def late_results(spark, folder):
    """Views wait for the first click of their user; none in time leaves them incomplete."""
    events = spread(read_table(spark, folder, "events"), "event_id").select("event_id", "user_id", "event_type", X.epoch_micros(F.col("ts")).alias("at"))
    parts = events.where("event_type = 'view'").select("event_id", "user_id", "at")
    results = events.where("event_type = 'click'").select(F.col("event_id").alias("result_id"), "user_id", "at")
    found = ordered.first_result_within(parts, results, "user_id", "at", _WAIT)
    return found.select(
        "event_id", "user_id", or_minus_one("result_id"),
        F.coalesce(F.col("result_at") - F.col("at"), F.lit(-1)).alias("waited"),
        F.when(F.col("result_at").isNull(), S.INCOMPLETE).otherwise(S.ALLOWED).alias("verdict"),
    )


# --- scalar helpers over whole tables ---------------------------------------------------------------


@query(f"""
SELECT doc_id, left(regexp_replace(text, '[^A-Za-z0-9_:,.\\- ]', '', 'g'), 40) AS label,
       '••••' || right(md5(text), 4) AS masked, left(md5(text), 4) || '…' || right(md5(text), 4) AS masked_ends,
       CASE WHEN n_chars * 300 < 1048576 THEN printf('%.1f', n_chars * 300 / 1024.0) || ' KB'
            ELSE printf('%.2f', n_chars * 300 / 1048576.0) || ' MB' END AS size_text,
       format('{{:,}}', n_chars) AS chars_text, coalesce(nullif(n_chars % 5, 0), -1) AS int_or_null, regexp_matches(text, '\\S') AS filled,
       CASE WHEN n_chars % 3 = 0 THEN 'n/a' WHEN lang = 'de' THEN 'note only' ELSE 'yes' END AS forwarded
FROM documents
""")
def scalar_columns(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text", "n_chars", "lang"), "doc_id")
    digest = F.md5("text")
    return docs.select(
        "doc_id",
        X.clean_label(F.col("text"), 40).alias("label"),
        X.mask_secret(digest).alias("masked"),
        X.mask_secret_ends(digest).alias("masked_ends"),
        X.fmt_bytes(F.col("n_chars") * 300).alias("size_text"),
        X.fmt_thousands(F.col("n_chars")).alias("chars_text"),
        F.coalesce(X.int_or_null((F.col("n_chars") % 5).cast("string")), F.lit(-1)).alias("int_or_null"),
        (~X.is_blank(F.col("text"))).alias("filled"),
        X.forwarded_state(F.when(F.col("n_chars") % 3 != 0, 1), F.col("lang") != "de").alias("forwarded"),
    )
