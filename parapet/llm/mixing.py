"""Mixing sources to target weights, with DataFrame functions only."""

from pyspark.sql import functions as F

from parapet.llm.common import WORD, fresh, match, numbered, place, stored, uniform

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources, weights=WEIGHTS, share=SHARE, most=MOST):
    """Adds `target` to (source, source_size): `share` of all sizes, dealt by weight.

    Sources in code point order (null last) take the weights in turn. No target is above
    `most` times its source's size; what is cut off there is dealt again by weight among the
    others, until none is above. The driver holds four sums a round; a round ends with more
    sources at their limit than before, or is the last.
    """
    spark = sources.sparkSession
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__at") % len(weights) + 1).cast("int"))
    rows = stored(
        numbered(sources, order, "__at").withColumn("__weight", weight).withColumn("__most", F.col("source_size") * most)
    )
    level, full = 0.0, -1
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    while True:
        at_limit = F.col("__weight") * level >= F.col("__most")
        free, capped, n = rows.agg(
            F.sum(F.when(~at_limit, F.col("__weight"))), F.sum(F.when(at_limit, F.col("__most"))), F.sum(at_limit.cast("bigint"))
        ).first()
        if (n or 0) == full or not free:
            break
        full, level = n or 0, max(0.0, total * share - (capped or 0.0)) / free
    target = F.when(F.lit(free is None), F.col("__most")).otherwise(F.least("__most", F.col("__weight") * level))
    return rows.withColumn("target", target).drop("__at", "__weight", "__most")


def mix(sized, weights=WEIGHTS, share=SHARE, most=MOST, seed=7):
    """What the mix takes of each document, repeats counted.

    `sized`: a stored table of row_key, source, size (extra columns stay). Every row gets a
    hash-random key; within its source the rows are sorted by it in ranges, sizes are summed
    over ranges and inside them, and the source is cut where its budget (the rounded target)
    is reached: whole epochs first, then the rows before the cut, then part of the row at
    the cut. Same rows, same result. Rows of size 0 take nothing; a source of size 0 has
    target 0; an empty table gives an empty result; null is a source of its own.
    """
    ticked = sized.withColumn("__tick", uniform("row_key", seed=seed))
    sources = stored(ticked.groupBy("source").agg(F.sum("size").alias("source_size")))
    goals = stored(targets(sources, weights, share, most))
    placed = match(place(ticked, ["source"], "__tick", ["row_key"], "size"), goals, ["source"])
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("bigint"), F.least("size", rest - F.col("__before")))
    return placed.withColumn("taken", (epochs * F.col("size") + part).cast("bigint")).drop(
        "__tick", "__rank", "__before", "__group_rows"
    )


def size_documents(docs):
    """(doc_id, source, size, row_key) of the documents, stored: the texts are read once."""
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    return stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("row_key")))


def mixed_documents(docs, **options):
    """The mixed corpus: each document as often as the mix takes it, all columns kept.

    A document at a cut comes whole or not, whichever is nearer; no text is cut. Rows repeated
    with one doc_id and text come as often as the mix takes them together, in the form of one
    of them. Null texts and an empty table give nothing; extra columns may have any names.
    """
    mine, copies, rows, copy = (fresh(n, docs) for n in ("__key", "__copies", "__rows", "__copy"))
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    taken = mix(size_documents(docs), **options)
    wanted = F.round(F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0))).cast("int")
    counts = stored(taken.groupBy(F.col("row_key").alias(mine)).agg(wanted.alias(copies), F.count(F.lit(1)).alias(rows)).where(F.col(copies) > 0))
    joined = docs.withColumn(mine, key).join(counts, mine)
    each = joined.where(F.col(rows) == 1).unionByName(joined.where(F.col(rows) > 1).dropDuplicates([mine]))
    return each.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
