"""Readers. Bad rows are marked or empty, never a failed job."""

import io
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from parapet import schemas, settings as S
from parapet.operators import ledger, validate
from parapet.sources import known, snapshots


def read_table(spark, folder, name):
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df, *key):
    """Deal the rows out to as many tasks as the session setting `spark.parapet.scanTasks` says.

    Without it (on a cluster) a scan keeps its splits. Local sessions set it, since a
    small file with one row group is one task.
    """
    tasks = df.sparkSession.conf.get("spark.parapet.scanTasks", None)
    return df.repartition(int(tasks), *key) if tasks else df


def read_requests(spark, path):
    """Requests from lines of JSON: the body and its parts; unreadable lines have no contents."""
    lines = spark.read.text(path).withColumnRenamed("value", "body")
    return validate.parse_requests(lines, "body")


def read_files(spark, path, pattern="*", max_bytes=S.MAX_UPLOAD_BYTES):
    """Every file as a row: path, length, modificationTime, content, status, reason.

    The bytes of a file over the limit are not read: it comes with status 413 and a reason.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
    facts = ["path", "length", "modificationTime"]
    fits = files.where(F.col("length") <= max_bytes).select(
        *facts, "content", F.lit(200).alias("status"), F.lit(None).cast("string").alias("reason")
    )
    return fits.unionByName(files.where(F.col("length") > max_bytes).select(
        *facts, F.lit(None).cast("binary").alias("content"), F.lit(413).alias("status"),
        F.lit(f"The file is larger than {max_bytes:,} bytes.").alias("reason"),
    ))


def read_results(spark, path):
    """Screening results as one JSON text per line, unparsed; garbage becomes incomplete later."""
    return spark.read.text(path).withColumnRenamed("value", "result")


def _rows_or_none(spark, read):
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_runs(spark, path, runs):
    """Rows of the given runs of a ledger."""
    if not runs:
        return spark.createDataFrame([], schemas.LEDGER)
    return spark.read.schema(schemas.LEDGER).parquet(*[f"{path}/{r['folder']}" for r in runs])


def live_runs(spark, path, without_run=None):
    return [r for r in snapshots.load(snapshots.Folder(spark, path))[1]["runs"] if r["name"] != without_run]


def read_ledger(spark, path, without_run=None):
    """Stored ledger: the runs of its newest list; no list yet is an empty ledger.

    A reader that has resolved the list keeps its rows while others append or compact.
    """
    return read_runs(spark, path, live_runs(spark, path, without_run))


def new_to_ledger(log, path, without_run=None):
    """Rows of a log that the stored ledger does not have, as `ledger.new_entries`, reading only buckets that may know them.

    A log of many rows would name every bucket; its keys are not looked up in the filters, and all
    buckets are read.
    """
    spark = log.sparkSession
    runs = live_runs(spark, path, without_run)
    if log.select("id").limit(known.ASKED_AT_MOST + 1).count() > known.ASKED_AT_MOST:
        local = known.all_keys(spark, path, runs)
    else:
        asked = known.keys_of(log.select("id", "request_id", F.lit("asked").alias("source")))
        local = known.known_keys(spark, path, runs, asked)
    return ledger.new_entries(log, known.as_local(local))


def read_json_ledger(spark, path):
    """(good rows, unreadable lines) of a ledger stored as JSON lines."""
    found = _rows_or_none(spark, lambda: spark.read.text(path))
    if found is None:
        return spark.createDataFrame([], schemas.LEDGER), spark.createDataFrame([], "bad_line string")
    schema = T.StructType([*schemas.LEDGER.fields, T.StructField("bad_line", T.StringType())])
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": "bad_line"})
    rows = found.where(F.trim("value") != "").select(parsed.alias("row")).select("row.*")
    return rows.where("bad_line is null").drop("bad_line"), rows.where("bad_line is not null").select("bad_line")


def read_gateway_log(spark, path, limit=S.LOG_PULL, fields=schemas.LOG_FIELDS):
    """Newest entries of an outside log of JSON lines as ledger rows; limit=None takes all."""
    entries = spark.read.schema(schemas.LOG_ENTRY).json(path)
    if limit is not None:
        # By time, not by text: offsets and fractions are written in several ways. Ties have one order.
        at = F.col("timestamp").try_cast("timestamp")
        entries = entries.orderBy(at.desc_nulls_last(), F.col("insertId").asc_nulls_last()).limit(limit)
    return ledger.from_log(entries, fields)


def read_delimited_checked(spark, path, schema=schemas.INVENTORY):
    """(good rows, bad lines as they are) of comma-separated lines; one that does not fit the schema is not nulled. Header lines go."""
    wide = T.StructType([*schema.fields, T.StructField("bad_line", T.StringType())])
    lines = spark.read.text(path).where((F.trim("value") != "") & (F.regexp_replace("value", '[" ]', "") != ",".join(schema.names)))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}
    rows = lines.select(F.from_csv("value", wide.toDDL(), options).alias("row")).select("row.*")
    return rows.where("bad_line is null").drop("bad_line"), rows.where("bad_line is not null").select("bad_line")


def _unreadable(frames):
    for frame in frames:
        problems = []
        for content in frame["content"]:
            try:
                for _ in pq.ParquetFile(io.BytesIO(content)).iter_batches(batch_size=4096):
                    pass
                problems.append(None)
            except (pa.ArrowException, OSError) as error:
                problems.append(type(error).__name__)
        yield frame.assign(problem=problems)[["path", "length", "problem"]]


def read_ledger_checked(spark, path):
    """(rows of readable files, unreadable files) of a stored ledger; a damaged file costs its own rows and is named.

    Every file is opened on the executors; only the names of damaged ones come back.
    """
    runs = live_runs(spark, path)
    if not runs:
        return spark.createDataFrame([], schemas.LEDGER), spark.createDataFrame([], "path string, length bigint, problem string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{path}/{r['folder']}" for r in runs])
    checked = files.select("path", "length", "content").mapInPandas(_unreadable, "path string, length bigint, problem string")
    bad = checked.where("problem is not null").collect()
    found = spark.createDataFrame([tuple(r) for r in bad], "path string, length bigint, problem string")
    names = [r["path"].rsplit("/", 1)[1] for r in bad]
    rows = spark.read.schema(schemas.LEDGER).option("ignoreCorruptFiles", "true").parquet(*[f"{path}/{r['folder']}" for r in runs])
    good = rows.where(~F.col("_metadata.file_name").isin(names)) if names else rows
    return good.select([f.name for f in schemas.LEDGER.fields]), found


def read_delimited(spark, path, schema=schemas.INVENTORY):
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)
