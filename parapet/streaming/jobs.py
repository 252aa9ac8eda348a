"""Streaming forms. They reuse the batch functions; only time handling is added."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import detect as D
from parapet.operators import ledger as L, validate
from parapet.session import checkpoint_dir
from parapet.sources.readers import new_to_ledger
from parapet.sources.writers import append_ledger


def screen_stream(requests, body="body", max_chars=S.MAX_TEXT_CHARS):
    """Verdict per arriving request, without state: rejected, or the verdict of its text."""
    parsed = validate.validate_single(validate.parse_requests(requests, body), F.lit("native"), max_chars)
    text = F.when(F.col("ok"), F.get(F.col("parts"), F.lit(0)).text)
    screened = D.screen(parsed.withColumn("text", text), max_chars=max_chars)
    return screened.withColumn("verdict", F.when(F.col("ok"), F.col("verdict")).otherwise(S.ERROR)).select(
        *[c for c in requests.columns if c != body], "ok", "reason", "verdict", D.names_or_none(F.col("hits")).alias("filters")
    )


def dedupe_log(entries, delay="1 day"):
    """Log rows without repeats of an id, for as long as the watermark allows repeats to come."""
    timed = entries.where(F.col("id").isNotNull() & (F.col("id") != ""))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def kpis_by_window(rows, window="1 hour", slide=None, delay="1 hour"):
    """Ledger key figures per event-time window; rows later than the watermark are dropped."""
    span = F.window("ts", window) if slide is None else F.window("ts", window, slide)
    grouped = rows.withWatermark("ts", delay).groupBy(span).agg(*L.kpi_columns())
    return grouped.select(F.col("window.start").alias("window_start"), *[c for c in grouped.columns if c != "window"])


def sessions_by_user(rows, key="user_id", gap="30 minutes", delay="1 hour"):
    """Activity sessions of a key as they close."""
    span = F.session_window("ts", gap)
    grouped = rows.withWatermark("ts", delay).groupBy(key, span).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select(
        key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events"
    )


def await_results(parts, results, keys=("request_id", "n"), wait_seconds=S.RESULT_WAIT_SECONDS, delay="1 minute"):
    """Parts with their results; a part whose result does not arrive in time is incomplete.

    `parts` has part_ts, `results` has result_ts and verdict. Both sides are bounded by
    their watermarks, so the state holds only parts still waiting.
    """
    left = parts.withWatermark("part_ts", delay).alias("p")
    right = results.withWatermark("result_ts", delay).alias("r")
    match = F.col("r.result_ts").between(F.col("p.part_ts"), F.col("p.part_ts") + F.expr(f"INTERVAL {wait_seconds} SECONDS"))
    for k in keys:
        match = match & (F.col(f"p.{k}") == F.col(f"r.{k}"))
    joined = left.join(right, match, "left_outer")
    return joined.select(
        *[F.col(f"p.{k}") for k in keys], "part_ts", "result_ts",
        F.coalesce(F.col("r.verdict"), F.lit(S.INCOMPLETE)).alias("verdict"),
    )


def audit_sink(rows, path, name, trigger=None):
    """Append ledger rows batch by batch; a repeated batch rewrites its own run folder.

    Only ledger columns are written, so no content column can reach the ledger.
    """

    def write(batch, batch_id):
        append_ledger(batch, path, f"{name}-{batch_id}")

    return _start(rows, name, write, trigger)


def merge_sink(log, path, name, trigger=None):
    """Merge each batch of log rows into the stored ledger; known rows are left out.

    Of the ledger only the key buckets are read that may hold one of the batch's ids. A
    repeated batch does not look into the run that it is about to rewrite.
    """

    def write(batch, batch_id):
        run = f"{name}-{batch_id}"
        append_ledger(new_to_ledger(batch.dropDuplicates(["id"]), path, without_run=run), path, run)

    return _start(log, name, write, trigger)


def split_late(rows, path, name, ts="ts", delay="1 hour", trigger=None):
    """Rows split by the watermark before anything keeps state: `path`/on_time, `path`/late and `path`/marks.

    A row is late if it is older than the newest row of the earlier batches less `delay`, the
    rule by which a stateful operator would drop it unseen. marks has one row per batch: how
    many came in time and late, and the newest time. A repeated batch replaces its own folders
    and sees the same marks. Rows without a time are in time.
    """

    def write(batch, batch_id):
        spark = batch.sparkSession
        earlier = stored_batches(spark, path, "marks", "batch bigint, n_on_time bigint, n_late bigint, newest timestamp")
        limit = earlier.where(F.col("batch") < batch_id).agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("at")).first()["at"]
        late = F.coalesce(F.col(ts) < F.lit(limit), F.lit(False))
        batch = batch.persist()
        for side, which in (("late", late), ("on_time", ~late)):
            batch.where(which).write.mode("overwrite").parquet(f"{path}/{side}/batch={batch_id}")
        marks = batch.agg(F.count_if(~late).alias("n_on_time"), F.count_if(late).alias("n_late"), F.max(ts).alias("newest"))
        marks.write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
        batch.unpersist()

    return _start(rows, name, write, trigger)


def stored_batches(spark, path, side, schema):
    """What `split_late` has stored of one side; nothing yet is an empty table."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/{side}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _start(rows, name, write, trigger):
    writer = rows.writeStream.queryName(name).foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint_dir(rows.sparkSession, name))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
