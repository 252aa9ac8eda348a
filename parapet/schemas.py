"""Row shapes of requests, answers, ledger rows and log entries."""

from pyspark.sql import types as T

INLINE_DATA = T.StructType([
    T.StructField("mimeType", T.StringType()),
    T.StructField("data", T.StringType()),
])

# `text` and `inlineData` stay JSON text so that a number or an object in the
# wrong place is seen (and rejected) instead of silently becoming null.
CONTENTS = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("inlineData", INLINE_DATA),
    ]))),
]))

ANSWER_PART = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("thought", T.BooleanType()),
    T.StructField("inlineData", INLINE_DATA),
])

LEDGER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("scenario_id", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("filters", T.StringType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("latency_ms", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("request_id", T.StringType()),
])

PUBLIC_LEDGER = ["ts", "scenario_id", "mode", "filters", "http_status", "verdict", "latency_ms", "source"]

# Log payload fields, every value a string. A different log can be read by
# passing its own names for these.
LOG_FIELDS = {
    "ts": "ts",
    "scenario_id": "scenarioId",
    "mode": "mode",
    "filters": "filters",
    "latency_ms": "latencyMs",
    "http_status": "httpStatus",
    "request_id": "requestId",
}
LOG_ENTRY = T.StructType([
    T.StructField("insertId", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("jsonPayload", T.StringType()),
])

INVENTORY = T.StructType([
    T.StructField("sku", T.StringType()),
    T.StructField("region_hub", T.StringType()),
    T.StructField("units_in_stock", T.IntegerType()),
    T.StructField("wholesale_usd", T.DecimalType(10, 2)),
    T.StructField("lead_time_days", T.IntegerType()),
])
