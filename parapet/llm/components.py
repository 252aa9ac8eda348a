"""Connected components by contraction: every round halves the nodes that are left at least."""

from pyspark.sql import functions as F

from parapet.llm.common import drop_stored, stored


def _jump(pointers):
    """Follow the pointers (node -> smaller node) to their roots; chains halve with every pass."""
    while True:
        ends = pointers.select(F.col("node").alias("__n"), F.col("to").alias("__to"))
        further = stored(
            pointers.join(ends, pointers["to"] == ends["__n"], "left")
            .select("node", F.coalesce("__to", "to").alias("to"), (F.col("__to") < F.col("to")).alias("__moved"))
        )
        moved = further.where("__moved").limit(1).count()
        drop_stored(pointers)
        pointers = further.select("node", "to")
        if not moved:
            return pointers


def components(edges):
    """(node, label) for each node of the edges (a, b): label is its component's smallest node.

    Null ends and loops are ignored. Each round points every node to its smallest neighbour,
    follows the pointers to their roots, and goes on with the edges between roots. All steps
    are keyed joins of stored tables (which adaptive execution can split where a root is hot)
    and pre-aggregated minima.
    """
    pairs = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    labels = None
    while pairs.limit(1).count():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to")))
        roots = _jump(near)
        if labels is None:
            labels = roots
        else:
            onward = roots.select(F.col("node").alias("__n"), F.col("to").alias("__to"))
            grown = stored(
                labels.join(onward, labels["to"] == onward["__n"], "left").select("node", F.coalesce("__to", "to").alias("to"))
            )
            drop_stored(labels)
            labels = grown
        side = lambda c: roots.select(F.col("node").alias(c), F.col("to").alias(f"__{c}"))
        half = stored(pairs.join(side("a"), "a").select(F.col("__a").alias("a"), "b"))
        rest = stored(
            half.join(side("b"), "b").select("a", F.col("__b").alias("b")).where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
        drop_stored(pairs, half)
        pairs = rest
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).where(F.lit(False))
    return labels.select("node", F.col("to").alias("label"))
