"""Helpers of the training-data operators: tables, stored intermediates, ranks inside hot groups."""

import functools
import operator
import os
import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shipped(spark):
    """Lets Python workers on this machine import the package from where it lies; a cluster installs it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark, folder, name):
    shipped(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark):
    """The cluster's shared folder. Only a local session that names none (tests) gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="parapet-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df):
    """The rows written once to the shared folder and read again.

    Cuts the lineage (a lost executor costs no recomputation), makes random choices final,
    and gives the optimizer true sizes, so that it broadcasts what is small and nothing else.
    """
    shipped(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/parapet-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*frames):
    """Delete stored tables that a later stored table has replaced."""
    for df in frames:
        spark = df.sparkSession
        paths = {p.rsplit("/", 1)[0] for p in df.inputFiles() if "/parapet-llm/" in p}
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name, *frames):
    """A column name like `name` that none of the tables has, however it is written."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value, body):
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def uniform(*columns, seed=0):
    """A number in [0, 1) that depends on the columns' values only."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) * F.lit(2.0**-53)


def match(left, right, keys, how="inner"):
    """Join on keys where null equals null; the right side's keys go."""
    renamed = right.select([F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def place(df, keys, tick, order, value=None):
    """Rank (from 0) and prefix sum of each row within its keys, in the order of (tick, order).

    `tick` is a uniform number in [0, 1), `df` a stored table. A group of n rows is cut by
    tick into about sqrt(n) ranges of about sqrt(n) rows: each range is ordered on its own,
    and the ranges' totals are summed over sqrt(n) rows. So no task holds a whole hot group.
    Adds __rank, __before (sum of `value` over the earlier rows) and __group_rows.
    """
    amount = F.lit(1).cast("bigint") if value is None else F.col(value)
    groups = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__group_rows")))
    ranges = match(df, groups, keys).withColumn("__range", F.floor(F.col(tick) * F.ceil(F.sqrt("__group_rows"))))
    totals = stored(
        ranges.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__rows"), F.sum(amount).alias("__sum"))
    )
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "__range",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rank_from"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__sum_from"),
    )
    inside = W.partitionBy(*keys, "__range").orderBy(tick, *order).rowsBetween(W.unboundedPreceding, -1)
    ranked = ranges.withColumn("__rank", F.count(F.lit(1)).over(inside)).withColumn(
        "__before", F.coalesce(F.sum(amount).over(inside), F.lit(0))
    )
    return (
        match(ranked, starts, [*keys, "__range"])
        .withColumn("__rank", F.col("__rank") + F.col("__rank_from"))
        .withColumn("__before", F.col("__before") + F.col("__sum_from"))
        .drop("__rank_from", "__sum_from", "__range")
    )


def numbered(df, order, out):
    """Global position (from 0) by `order`: range partitions, ranked inside and shifted by the earlier ones' rows."""
    parts = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows")).select(
        "__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__from")
    )
    inside = W.partitionBy("__part").orderBy(*order)
    ranked = parts.withColumn(out, F.row_number().over(inside) - 1)
    return ranked.join(starts, "__part").withColumn(out, F.col(out) + F.col("__from")).drop("__part", "__from")


def in_tiles(df, keys, salt, tile):
    """Rows dealt to tiles of their group so that every pair of a group meets in one tile.

    A group of up to `tile` rows is one tile (0, 0). A larger one is cut into blocks by
    `salt`; each pair of blocks (i, j) is a tile, so a hot group is many tasks' work and no
    pair is emitted. Adds __i, __j and __block (the row's own block).
    """
    hot = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > tile))
    cut = match(df, hot, keys, "left").withColumn(
        "__blocks", F.coalesce(F.ceil(F.col("__rows") / tile), F.lit(1)).cast("int")
    )
    cut = cut.withColumn("__block", F.floor(salt * F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    return (
        cut.select("*", other.alias("__other"))
        .withColumn("__i", F.least("__block", "__other"))
        .withColumn("__j", F.greatest("__block", "__other"))
        .drop("__rows", "__blocks", "__other")
    )
