"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from pyspark.sql import functions as F

from parapet.llm.common import place, stored, uniform

PER_RACK = 4
RACKS = 2


def layout(shards, per_rack=PER_RACK, racks=RACKS):
    """Equal shards filled rack by rack and region by region: {(region, rack): [(shard, weight)]}."""
    tree = {}
    for s in range(shards):
        tree.setdefault((s // (per_rack * racks), s // per_rack), []).append((s, 1.0))
    return tree


def _draw(key, level, children, seed):
    """The child with the smallest exponential draw of its weight's rate.

    A draw depends on key, level, child and weight only: a child whose weight grows wins
    keys and its siblings lose them only to it.
    """
    wait = lambda c: -F.log(uniform(key, F.lit(level), c["child"], seed=seed) + F.lit(2.0**-54)) / c["weight"]
    return F.array_min(F.transform(children, lambda c: F.struct(wait(c).alias("wait"), c["child"].alias("child"))))["child"]


def shard_of(key, tree, seed=11):
    """Shard of a key: descend region, rack and shard, one weighted draw each.

    A node's weight is the sum of its shards' weights. A change of weights moves keys only
    into or out of the subtrees whose weights change; a shard that joins as a region of its
    own therefore takes keys only into itself.
    """
    regions, racks, shards = {}, {}, {}
    for (region, rack), leaves in tree.items():
        weight = sum(w for _, w in leaves)
        regions[region] = regions.get(region, 0.0) + weight
        racks.setdefault(region, []).append((rack, weight))
        shards[rack] = leaves
    listed = lambda pairs: F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in pairs])
    below = lambda nodes: F.create_map(*[x for n, pairs in nodes.items() for x in (F.lit(n), listed(pairs))])
    region = _draw(key, 0, listed(regions.items()), seed)
    rack = _draw(key, 1, F.element_at(below(racks), region), seed)
    return _draw(key, 2, F.element_at(below(shards), rack), seed)


def shard(docs, shards=16, seed=11):
    """Each document's shard, its place there, and its shard if there were one more.

    The shard depends on doc_id and the shard count only; equal (also null) ids share it.
    Null texts have size 1 (no bytes) and checksum 0. Places of a shard run from 0 without
    gaps, ordered by a hash of the id; a shard's rows are ranked in ranges, not in one task.
    """
    narrow = stored(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), layout(shards), seed).alias("shard"),
        shard_of(F.col("doc_id"), layout(shards + 1), seed).alias("grown_shard"),
        uniform("doc_id", F.coalesce("text", F.lit("")), seed=seed).alias("__tick"),
    ))
    placed = place(narrow, ["shard"], "__tick", ["doc_id", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("__rank").cast("bigint").alias("slot"), "grown_shard"
    )
