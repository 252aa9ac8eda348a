"""Ordered operators that survive one key holding a large share of all rows.

A plain window over a key puts all its rows into one task. Here a key with many rows is cut
into ranges of its order column, every range is handled on its own, and one small row per
range carries what the next range has to know. The borders of the ranges are quantiles of
the key's own order values, so neither sparse values nor bursts matter.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 65_536
BORDERS = 1024
ACCURACY = 10_000


def _keyed(df, keys):
    """Adds __key: the keys as one value, where null equals null."""
    return df.withColumn("__key", F.struct(*keys))


def hot_borders(rows, order, most=HOT_ROWS):
    """Of each __key with more than `most` rows: its number of rows and the borders of about sqrt(rows) ranges.

    Borders come from a quantile sketch of the order column that is filled before the
    shuffle. Beyond BORDERS ranges each is cut into __pieces of equal width.
    """
    counts = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    values = rows.select("__key", F.col(order).cast("bigint").alias("__at")).join(counts, "__key")
    shares = [i / BORDERS for i in range(BORDERS + 1)]
    sketch = values.groupBy("__key", "__n").agg(F.percentile_approx("__at", shares, ACCURACY).alias("__all"))
    ranges = F.ceil(F.sqrt("__n"))
    every = F.greatest(F.lit(1), F.floor(BORDERS / ranges)).cast("int")
    return sketch.select(
        "__key", "__n", F.filter("__all", lambda _, i: (i % every == 0) | (i == BORDERS)).alias("__borders"),
        F.ceil(ranges / BORDERS).alias("__pieces"),
    )


def with_ranges(df, order, borders):
    """Adds __range, which grows with the order value: 0 for keys that are not cut, -1 for nulls of those that are."""
    at = F.col(order).cast("bigint")
    halves = F.array(*[F.lit(BORDERS >> i) for i in range(BORDERS.bit_length())])
    # Binary search: how many borders are at most the value.
    below = F.aggregate(halves, F.lit(0), lambda n, s: F.when(F.get("__borders", n + s - 1) <= at, n + s).otherwise(n))
    low, high = F.get("__borders", F.col("__below") - 1), F.get("__borders", F.col("__below"))
    inside = F.floor((at - low) / (high - low) * F.col("__pieces"))
    piece = F.coalesce(F.least(F.greatest(inside, F.lit(0)), F.col("__pieces") - 1), F.lit(0))
    cut = F.when(at.isNull(), F.lit(-1)).otherwise(F.col("__below") * F.col("__pieces") + piece)
    found = df.join(borders, "__key", "left").withColumn("__below", below)
    return found.withColumn("__range", F.when(F.col("__n").isNull(), F.lit(0)).otherwise(cut).cast("bigint")).drop(
        "__n", "__borders", "__pieces", "__below"
    )


def _hot(rows, order, most):
    """Borders of the keys that are to be cut, None where there is no such key (asked with one small job)."""
    counts = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    return None if counts.isEmpty() else hot_borders(rows, order, most)


def number_rows(df, keys, order, out="n", most=HOT_ROWS, counted=None):
    """1-based position of each row within its key, by a unique integer column; null keys are a key, null orders come first.

    `counted` has the same rows with the keys and the order column at least; rows are
    counted on it, so that nothing costly in df is computed for the counts. Only keys with
    more than `most` rows are cut into ranges.
    """
    plain = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    counted = _keyed((df if counted is None else counted).select(*keys, order), keys).select("__key", order)
    borders = _hot(counted, order, most)
    if borders is None:
        return df.withColumn(out, plain)
    earlier = W.partitionBy("__key").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        with_ranges(counted, order, borders).groupBy("__key", "__range").agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__offset", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
        .drop("__rows")
    )
    within = W.partitionBy("__key", "__range").orderBy(order)
    ranked = with_ranges(_keyed(df, keys), order, borders).withColumn("__row", F.row_number().over(within))
    numbered = ranked.join(offsets, ["__key", "__range"])
    return numbered.withColumn(out, F.col("__row") + F.col("__offset")).drop("__row", "__offset", "__range", "__key")


def last_known_before(df, keys, order, value, out, most=HOT_ROWS):
    """Last non-null value among the earlier rows of the key, null when there is none."""
    before = lambda *of: W.partitionBy(*of).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = lambda *of: F.last(value, ignorenulls=True).over(before(*of))
    rows = _keyed(df.select(*dict.fromkeys([*keys, order, value])), keys).select("__key", *dict.fromkeys([order, value]))
    borders = _hot(rows, order, most)
    if borders is None:
        return df.withColumn(out, local(*keys))
    known = F.when(F.col(value).isNotNull(), F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**63))))
    over = W.partitionBy("__key").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        with_ranges(rows, order, borders).groupBy("__key", "__range").agg(F.max_by(value, known).alias("__last"))
        .withColumn("__carry", F.last("__last", ignorenulls=True).over(over))
        .drop("__last")
    )
    found = with_ranges(_keyed(df, keys), order, borders).withColumn("__local", local("__key", "__range"))
    return (
        found.join(carried, ["__key", "__range"])
        .withColumn(out, F.coalesce("__local", "__carry"))
        .drop("__local", "__carry", "__range", "__key")
    )


def part_latency(df, keys, order, at, start=None, most=HOT_ROWS):
    """Milliseconds of each step: its time minus the last known earlier time.

    Unknown times and steps back in time give null. `start` is the time before step one.
    """
    steps = last_known_before(df, keys, order, at, "__prev", most)
    prev = F.col("__prev") if start is None else F.coalesce(F.col("__prev"), F.col(start))
    ms = F.when(F.col(at) >= prev, F.col(at) - prev)
    return steps.withColumn("ms", ms).drop("__prev")


def request_latency(df, keys, order, at, start):
    """Total check time per key: the last known mark minus the start, 0 where unknown or negative."""
    known = F.when(F.col(at).isNotNull(), F.col(order))
    last = df.groupBy(*keys).agg(F.max_by(at, known).alias("__at"), F.max(start).alias("__start"))
    total = F.greatest(F.lit(0), F.coalesce(F.col("__at") - F.col("__start"), F.lit(0))).cast("bigint")
    return last.select(*keys, total.alias("total_ms"))


SLOTS = 64


def first_result_within(parts, results, key, at, wait, result_cols=("result_id",)):
    """Each part with the first result of its key that arrives within `wait` time units.

    Time is cut into slots of a fraction of `wait`. The first result after a part is later
    in its own slot (an ordered scan of one slot) or the first of a later slot, which is
    carried back over one row per slot; no pairs are built. Parts without a result keep nulls.
    """
    slot = F.floor(F.col(at) * SLOTS / wait)
    arrival = F.struct(F.col(at).alias("at"), *[F.col(c) for c in result_cols])
    tagged = results.select(key, F.col(at), arrival.alias("__hit"))
    hit_type = tagged.schema["__hit"].dataType
    both = parts.select("*", F.lit(None).cast(hit_type).alias("__hit"), F.lit(True).alias("__is_part")).unionByName(
        tagged.withColumn("__is_part", F.lit(False)), allowMissingColumns=True
    ).withColumn("__slot", slot)
    after = W.partitionBy(key).orderBy(F.col("__slot").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = both.select(key, "__slot", "__hit").groupBy(key, "__slot").agg(F.min("__hit").alias("__first")).select(
        key, "__slot", F.last("__first", ignorenulls=True).over(after).alias("__next")
    )
    # Latest first, so "what comes later" is a running frame and costs one pass. A result
    # of the same instant counts as later than the part.
    later = (
        W.partitionBy(key, "__slot")
        .orderBy(F.col(at).desc(), "__is_part", F.col("__hit").desc())
        .rowsBetween(W.unboundedPreceding, -1)
    )
    scanned = both.withColumn("__same", F.last("__hit", ignorenulls=True).over(later)).where("__is_part")
    joined = scanned.join(carried, [key, "__slot"], "left")
    joined = joined.withColumn("__found", F.coalesce("__same", "__next"))
    found = F.when(F.col("__found.at") - F.col(at) <= wait, F.col("__found"))
    return (
        joined.withColumn("__found", found)
        .select("*", F.col("__found.at").alias("result_at"), *[F.col(f"__found.{c}") for c in result_cols])
        .drop("__found", "__same", "__next", "__hit", "__is_part", "__slot")
    )


def sessions(df, key, at, gap):
    """Sessions of a key: an event belongs to the session that ended at most `gap` before it.

    Two events of a key in one `gap` of time are always one session, so events are first
    counted by such buckets, partly before the shuffle; only one row per bucket is sorted.
    """
    buckets = df.groupBy(key, F.floor(F.col(at) / gap).alias("__bucket")).agg(
        F.min(at).alias("__start"), F.max(at).alias("__end"), F.count(F.lit(1)).alias("__n")
    )
    across = W.partitionBy(key).orderBy("__bucket")
    apart = F.coalesce(F.col("__start") - F.lag("__end").over(across) > gap, F.lit(True)).cast("int")
    merged = buckets.withColumn("__apart", apart).withColumn("__session", F.sum("__apart").over(across))
    return merged.groupBy(key, "__session").agg(
        F.min("__start").alias("session_start"),
        (F.max("__end") + gap).alias("session_end"),
        F.sum("__n").alias("n_events"),
    ).drop("__session")
