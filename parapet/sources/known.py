"""Which ids a ledger knows, without reading it: keys in buckets, with a Bloom filter for each bucket of a run.

A run's keys are its rows' ids and the request ids of rows recorded here. They are dealt to
buckets by hash. A filter is a bitmap of 32,768 bits (as many per bucket as its keys need);
a lookup reads the filters, and then only those buckets of those runs that may hold a key.
"""

import functools
import math
import operator
from urllib.parse import unquote

from pyspark.sql import functions as F

from parapet.operators.ledger import EXTERNAL

BUCKETS = 16
BITS = 32768
KEYS_PER_BITMAP = 3000
SEEDS = (11, 23, 37)
# Rows of a log whose keys are looked up in the filters. A full filter takes one new key of 72 for a
# known one, a half full one of 475, so more rows name nearly every bucket whatever their keys are;
# the buckets of emptier filters are small.
ASKED_AT_MOST = 20_000
BITMAPS_PER_FILE = 1024
KEY = "kind string, key string"
FILTER = "bucket int, slice int, bits binary"


def keys_of(rows):
    """Distinct (kind, key): every id, and the request ids of rows that were not taken from an outside log."""
    own = F.when(F.col("source") != EXTERNAL, F.col("request_id"))
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    return rows.select(F.inline(F.array(pair("id", F.col("id")), pair("request", own)))).where(F.col("key").isNotNull()).distinct()


def _hash(seed=0):
    return F.xxhash64("kind", "key", F.lit(seed))


def _placed(keys, buckets):
    return keys.withColumn("bucket", F.pmod(_hash(), F.lit(buckets)).cast("int"))


def _slice(slices):
    return F.pmod(F.shiftright(_hash(), 20), slices).cast("int")


def _bits():
    return [F.pmod(_hash(s), F.lit(BITS)) for s in SEEDS]


def write_keys(spark, rows, keys_path, filters_path, buckets=BUCKETS):
    """Write a run's keys by bucket and the filters over them; returns the number of bitmaps per bucket."""
    placed = _placed(keys_of(rows), buckets)
    placed.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(keys_path)
    stored = spark.read.schema(f"{KEY}, bucket int").parquet(keys_path)
    most = stored.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    slices = 2 ** max(0, math.ceil(math.log2(max(most, 1) / KEYS_PER_BITMAP)))
    marked = stored.select("bucket", _slice(F.lit(slices)).alias("slice"), F.explode(F.array(*_bits())).alias("bit"))
    marked.groupBy("bucket", "slice").agg(F.bitmap_construct_agg("bit").alias("bits")).coalesce(max(1, buckets * slices // BITMAPS_PER_FILE)).write.parquet(filters_path)
    return slices


def _is_set(bits, bit):
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0


def candidate_buckets(spark, path, runs, keys, buckets=BUCKETS):
    """[(run folder, bucket)] that may hold one of the keys; as many as there are runs and buckets at most."""
    if not runs:
        return []
    placed = _placed(keys, buckets)
    shapes = sorted({r["slices"] for r in runs})
    asked = placed.select(
        "bucket", F.explode(F.array(*[F.struct(F.lit(s).alias("slices"), _slice(F.lit(s)).alias("slice")) for s in shapes])).alias("at"),
        F.array(*_bits()).alias("asked"),
    ).select("bucket", "at.*", "asked")
    found = []
    for s in shapes:
        folders = [f"{path}/_filters/{r['folder']}" for r in runs if r["slices"] == s]
        filters = spark.read.schema(FILTER).parquet(*folders).select("*", F.col("_metadata.file_path").alias("file"))
        every = functools.reduce(operator.and_, [_is_set(F.col("bits"), F.get("asked", F.lit(i))) for i in range(len(SEEDS))])
        hits = asked.where(F.col("slices") == s).join(filters, ["bucket", "slice"]).where(every)
        found += [(unquote(r["file"]), r["bucket"]) for r in hits.select("file", "bucket").distinct().collect()]
    return sorted({(r["folder"], bucket) for file, bucket in found for r in runs if f"/{r['folder']}/" in file})


def known_keys(spark, path, runs, keys, buckets=BUCKETS):
    """The rows (kind, key) of the buckets that may hold one of the keys; no other file is read."""
    places = candidate_buckets(spark, path, runs, keys, buckets)
    if not places:
        return spark.createDataFrame([], KEY)
    return spark.read.schema(KEY).parquet(*[f"{path}/_keys/{folder}/bucket={b}" for folder, b in places])


def all_keys(spark, path, runs):
    """The rows (kind, key) of all buckets."""
    if not runs:
        return spark.createDataFrame([], KEY)
    return spark.read.schema(KEY).option("recursiveFileLookup", "true").parquet(*[f"{path}/_keys/{r['folder']}" for r in runs])


def as_local(known):
    """Known keys in the shape of ledger rows, for `ledger.new_entries`."""
    value = lambda kind: F.when(F.col("kind") == kind, F.col("key"))
    return known.select(value("id").alias("id"), value("request").alias("request_id"), F.lit("ledger").alias("source"))
