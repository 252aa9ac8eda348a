"""The audit ledger: names, verdicts and timings of every request, never content."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parapet import schemas, settings as S
from parapet.functions import scalars as X
from parapet.operators import verdicts as V

EXTERNAL = "external-log"


def audit_message(df, **columns):
    """Log records from an explicit list of columns; whatever else a row holds stays behind."""
    return df.select(*[col.alias(name) for name, col in columns.items()])


def telemetry(header, body, requested_mode):
    """Screening telemetry: response headers first, the error body as fallback.

    `header` is a map of lower-case header names, `body` the JSON answer.
    """
    get = lambda name: F.nullif(F.try_element_at(header, F.lit(name)), F.lit(""))
    in_body = lambda field: F.nullif(F.get_json_object(body, f"$.error.screening.{field}"), F.lit(""))
    raw = F.try_element_at(header, F.lit("x-filters"))
    listed = F.filter(F.transform(F.split(raw, ","), lambda s: F.trim(s)), lambda f: (f != "") & (f != "none"))
    filters = F.when(raw.isNotNull(), listed).otherwise(X.string_list(in_body("matchedFilters")))
    label = lambda name, field: F.nullif(X.clean_label(F.coalesce(get(name), in_body(field)), 16), F.lit(""))
    return F.struct(
        F.coalesce(label("x-mode", "mode"), requested_mode).alias("mode"),
        label("x-verdict", "verdict").alias("verdict"),
        F.transform(filters, lambda f: X.clean_label(f, 40)).alias("filters"),
        X.int_or_null(F.coalesce(get("x-latency-ms"), in_body("latencyMs"))).alias("latency_ms"),
        F.nullif(X.clean_label(get("x-input"), 16), F.lit("")).alias("input"),
    )


def from_log(entries, fields=schemas.LOG_FIELDS, keep=()):
    """Ledger rows from outside log entries (insertId, timestamp, jsonPayload as JSON text), beside the columns to keep."""
    # One parse per entry; a payload that is not an object reads as an empty one.
    payload = ", ".join(f"`{name}` string" for name in fields.values())
    entries = entries.withColumn("__payload", F.from_json("jsonPayload", payload))
    get = lambda name: F.col("__payload")[fields[name]]
    or_null = lambda col: F.nullif(col, F.lit(""))
    status = F.coalesce(X.int_or(get("http_status")), F.lit(0)).cast("int")
    return entries.select(
        F.col("insertId").alias("id"),
        F.coalesce(or_null(F.col("timestamp")), or_null(get("ts"))).try_cast("timestamp").alias("ts"),
        X.clean_label(F.coalesce(or_null(get("scenario_id")), F.lit("external")), 64).alias("scenario_id"),
        or_null(X.clean_label(get("mode"), 16)).alias("mode"),
        or_null(X.clean_label(get("filters"))).alias("filters"),
        status.alias("http_status"),
        F.when(status != 0, V.status_verdict(status)).otherwise(S.ERROR).alias("verdict"),
        X.int_or_null(get("latency_ms")).cast("int").alias("latency_ms"),
        F.lit(EXTERNAL).alias("source"),
        or_null(X.clean_label(get("request_id"), 80)).alias("request_id"),
        *keep,
    )


def new_entries(log, local):
    """Log rows the ledger does not have: with an id, not merged before, not recorded locally.

    Both lookups are anti joins against distinct keys, so a key that many rows share is
    one row on the lookup side. A row without a request id is looked up under a key of its
    own, which nothing has, so that such rows do not meet in one task.
    """
    known = local.select("id").where(F.col("id").isNotNull()).distinct()
    recorded = (
        local.where(F.col("request_id").isNotNull() & (F.col("source") != EXTERNAL)).select("request_id").distinct()
    )
    own = F.coalesce("request_id", F.concat(F.lit("\0"), "id"))
    return (
        log.where(F.col("id").isNotNull() & (F.col("id") != ""))
        .join(known, "id", "left_anti")
        .withColumn("__request", own)
        .join(recorded.withColumnRenamed("request_id", "__request"), "__request", "left_anti")
        .drop("__request")
    )


def merge_log(local, log, pull=None):
    """Ledger with the new log rows; `pull` takes only the newest entries of the log."""
    if pull is not None:
        log = log.orderBy(F.col("ts").desc_nulls_last(), "id").limit(pull)
    return local.unionByName(new_entries(log, local).select(local.columns))


def newest(df, keep=S.LEDGER_KEEP):
    """Retention: the newest rows, those without a time last."""
    return df.orderBy(F.col("ts").desc_nulls_last(), "id").limit(keep)


def page(df, size=S.LEDGER_PAGE, columns=schemas.PUBLIC_LEDGER):
    """First page of the ledger, public columns only."""
    return newest(df, size).select(*columns)


def ranked(df, keep=S.LEDGER_KEEP):
    """Retained rows with their rank; the window sees at most `keep` rows."""
    order = W.orderBy(F.col("ts").desc_nulls_last(), "id")
    return newest(df, keep).withColumn("rank", F.row_number().over(order))


def search(df, q):
    """Case-insensitive substring over the visible columns; blank keeps everything."""
    q = q.strip().lower()
    if not q:
        return df
    visible = ["scenario_id", "mode", "filters", "verdict", "http_status"]
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in visible])
    return df.where(F.contains(F.lower(joined), F.lit(q)))


def kpi_columns():
    """Key figures: an error counts as blocked, a missing latency as zero."""
    total, allowed = F.count(F.lit(1)), F.count_if(F.col("verdict") == S.ALLOWED)
    rate = F.when(total > 0, F.floor((total - allowed) * 100 / total + 0.5)).otherwise(0)
    return [
        total.alias("total"),
        allowed.alias("allowed"),
        (total - allowed).alias("blocked"),
        rate.cast("bigint").alias("block_rate"),
        F.coalesce(F.avg(F.coalesce("latency_ms", F.lit(0))), F.lit(0.0)).alias("mean_latency_ms"),
    ]


def kpis(df, *by):
    return df.groupBy(*by).agg(*kpi_columns())
