"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parapet.llm.common import in_tiles, stored, uniform
from parapet.llm.components import components
from parapet.llm.simhash import spanning, whole_tiles

SIMILAR = 0.95
WIDTH = 2.2
RECALL = 0.98
BUCKET_ROWS = 64
TILE = 1024
SEED = 5


def collision(distance, width=WIDTH):
    """Chance that one quantised Gaussian projection of two points at a distance is equal."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_shape(n, similar=SIMILAR, width=WIDTH, recall=RECALL, bucket=BUCKET_ROWS):
    """(projections per table, tables): unrelated vectors share buckets of about `bucket` of n rows,
    and a pair at the threshold meets in some table with the chance `recall`."""
    far, near = collision(math.sqrt(2.0), width), collision(math.sqrt(2 - 2 * similar), width)
    projections = max(1, math.ceil(math.log(max(n / bucket, 1.0)) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


def valid(vector):
    """Neither null, empty nor zero, all components finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _normal(matrix):
    """Rows at length 1; scaled first, so that squares neither overflow nor vanish."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _matrix(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _coded(batches, projections, tables, width, seed):
    """Adds the vector's bucket in each table."""
    drawn = {}
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column("vector")])
        codes = np.zeros((batch.num_rows, tables), dtype=np.int64)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            if dim not in drawn:
                rng = np.random.default_rng([seed, int(dim)])
                drawn[dim] = rng.standard_normal((int(dim), tables * projections)), rng.random(tables * projections) * width
                drawn[dim] += (rng.integers(1, 2**63, projections, dtype=np.uint64) | np.uint64(1),)
            normals, shifts, mix = drawn[dim]
            x = _normal(_matrix(batch.column("vector").take(pa.array(rows))))
            cells = np.floor((x @ normals + shifts) / width).astype(np.int64).view(np.uint64).reshape(len(rows), tables, projections)
            h = np.full((len(rows), tables), int(dim), dtype=np.uint64)
            for k in range(projections):
                h = (h ^ cells[:, :, k] * mix[k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            codes[rows] = h.view(np.int64)
        flat = pa.ListArray.from_arrays(np.arange(len(codes) + 1, dtype=np.int32) * tables, pa.array(codes.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "codes"])


def _linked(batches, similar):
    """For each node with a link in a tile: the rows it links to, and the tile's smallest node that it reaches.

    A pair counts in the first table where it shares a bucket only.
    """
    names = ["t", "bucket", "dims", "__i", "__j"]
    for table in whole_tiles(batches, names):
        keys = [table.column(c).to_numpy() for c in names]
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.flatnonzero(new)
        for lo, hi in zip(starts, np.append(starts[1:], table.num_rows)):
            if hi - lo < 2:
                continue
            part = table.slice(lo, hi - lo)
            x, codes = _normal(_matrix(part.column("vector"))), np.array(part.column("codes").to_pylist(), dtype=np.int64)
            node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
            t, i, j = (int(k[lo]) for k in (keys[0], keys[3], keys[4]))
            cut = int((part.column("__block").to_numpy() == i).sum()) if i != j else 0
            if i == j:
                a, b = np.nonzero(np.triu(x @ x.T >= similar, 1))
            else:
                a, b = np.nonzero(x[:cut] @ x[cut:].T >= similar)
                b = b + cut
            first = _first(codes, t, a, b)
            a, b = a[first], b[first]
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
            label = spanning(len(node), a, b)
            rows = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[rows]), pa.array(links[rows].astype(np.int64)), pa.array(node[label[rows]])], ["node", "links", "root"]
            )


def _first(codes, t, a, b):
    out = np.ones(len(a), dtype=bool)
    for at in range(0, len(a), 100_000):
        p, q = a[at : at + 100_000], b[at : at + 100_000]
        for earlier in range(t):
            out[at : at + 100_000] &= codes[p, earlier] != codes[q, earlier]
    return out


def near_duplicates(rows, similar=SIMILAR, width=WIDTH, recall=RECALL, tile=TILE, seed=SEED):
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding): links are cosines of at least `similar`.

    Equal vectors are one node, compared once and counted as often as they occur. Nodes go
    to a bucket of each table; large buckets are dealt to tiles; a tile gives counts and a
    spanning forest, never its pairs. Cosines are exact (double precision), so no link is
    wrong; a pair at the threshold is found with the chance `recall`, a closer one almost
    surely. Null, empty and zero vectors and such with null or non-finite components link
    with nothing; vectors of different lengths do not link; repeated vec_ids get the row's
    own vector's counts, and each counts as a row.
    """
    rows = stored(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector")))
    good = rows.where(valid(F.col("vector"))).select("vec_id", F.transform("vector", lambda x: x.cast("double") + 0.0).alias("vector"))
    nodes = stored(
        good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), "least", "copies", "vector", F.size("vector").alias("dims"))
    )
    projections, tables = table_shape(nodes.count(), similar, width, recall)
    coded = nodes.select("node", "copies", "dims", "vector").mapInArrow(
        lambda it: _coded(it, projections, tables, width, seed),
        "node bigint, copies bigint, dims int, vector array<double>, codes array<bigint>",
    )
    coded = stored(coded)
    keyed = coded.select("*", F.posexplode("codes").alias("t", "bucket"))
    order = ["t", "bucket", "dims", "__i", "__j"]
    tiles = in_tiles(keyed, ["t", "bucket", "dims"], uniform("node", seed=seed), tile)
    dealt = tiles.repartition(*order).sortWithinPartitions(*order, "__block", "node")
    found = stored(
        dealt.select("node", "copies", "vector", "codes", *order, "__block")
        .mapInArrow(lambda it: _linked(it, similar), "node bigint, links bigint, root bigint")
    )
    labels = stored(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    counts = stored(found.groupBy("node").agg(F.sum("links").alias("links")))
    named = stored(
        nodes.join(labels, "node", "left").join(counts, "node", "left")
        .select("least", "copies", "vector", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    smallest = stored(named.groupBy("label").agg(F.min("least").alias("component_id")))
    result = stored(named.join(smallest, "label").select(
        F.col("vector").alias("__vector"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"
    ))
    own = F.when(valid(F.col("vector")), F.transform("vector", lambda x: x.cast("double") + 0.0))
    joined = rows.withColumn("__own", own).join(result, F.col("__own") == F.col("__vector"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
