"""SimHash near-duplicates by bit-sliced comparison."""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parapet.llm.common import fresh, in_tiles, stored, uniform
from parapet.llm.components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 2048
BUCKET_ROWS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text, width):
    """Hashes of a text's word shingles in their order, repeats included; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts[:n], ends[min(width, len(words)) - 1 :])]
    return np.array(hashes, dtype="<u8")


def fingerprint(text, width=SHINGLE):
    """64-bit SimHash of a text: majority of the hash bits of its word shingles, repeats included.

    Words are runs of what is not ASCII white space, A-Z lower-cased; a text of fewer words
    than a shingle is one shingle; no words give 0.
    """
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    if not n:
        return 0
    hashes = hashes.view(np.uint8).reshape(n, 8)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 4096):
        votes += np.unpackbits(hashes[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs, keep=()):
    """(doc_id, fp, kept columns) with fp as a signed 64-bit number; null texts are empty."""

    def work(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py() or "") for t in batch.column(1)]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed), *rest], ["doc_id", "fp", *keep])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *keep)
    schema = "".join(f", `{c}` {read.schema[c].dataType.simpleString()}" for c in keep)
    return read.mapInArrow(work, f"doc_id bigint, fp bigint{schema}")


def block_masks(n, radius=RADIUS, bucket=BUCKET_ROWS):
    """Bit masks such that fingerprints within the radius agree on at least one of them.

    The bits are cut into blocks; of `blocks` blocks, all but `radius` agree. As many blocks
    are taken as keep the mean bucket of n fingerprints small.
    """
    blocks = radius + 1
    while n / 2.0 ** (BITS * (blocks - radius) / blocks) > bucket and blocks < 12:
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(parts[i] for i in kept) for kept in itertools.combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_pairs(fps, lo, hi, radius=RADIUS):
    """Pairs (row, other) with other in [lo[row], hi[row]) and at most `radius` differing bits.

    Bit planes stand vertically: one word holds one bit of 64 fingerprints. Each row meets
    the words of its range; differing bits are added by carry-save counters, which start so
    that they overflow just above the radius; words whose lanes have all overflowed, and so
    exceed the radius, are abandoned.
    """
    n = len(fps)
    words = -(-n // 64)
    bits = np.zeros((words * 64, 8), dtype=np.uint8)
    bits[:n] = fps.view(np.uint8).reshape(n, 8)
    planes = np.packbits(np.unpackbits(bits, axis=1, bitorder="little").T.copy(), axis=1, bitorder="little").view(np.uint64)
    first, last = lo // 64, -(-hi // 64)
    many = np.where(hi > lo, last - first, 0)
    row = np.repeat(np.arange(n), many)
    word = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    from_lane = np.clip(lo[row] - word * 64, 0, 63).astype(np.uint64)
    to_lane = np.clip(hi[row] - word * 64, 1, 64).astype(np.uint64)
    wanted = (FULL << from_lane) & (FULL >> (np.uint64(64) - to_lane))
    depth = max(1, int(radius).bit_length())
    start = (1 << depth) - 1 - radius
    counters = [np.full(len(row), FULL if start >> d & 1 else 0, dtype=np.uint64) for d in range(depth)]
    over = ~wanted
    for b in range(BITS):
        flip = np.uint64(0) - (fps[row] >> np.uint64(b) & np.uint64(1))
        carry = planes[b][word] ^ flip
        for d in range(depth):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over |= carry
        if b % 8 == 7:
            alive = over != FULL
            if not alive.all():
                row, word, over = row[alive], word[alive], over[alive]
                counters = [c[alive] for c in counters]
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(near)
    return row[at], word[at] * 64 + lane


def spanning(n, a, b):
    """Smallest reachable index of each of n nodes under the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def ranges_of(keys, blocks, i, j):
    """Partner range of each row of sorted tiles: later rows of the tile, or the other block's rows."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in (*keys, i, j):
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    tile = np.cumsum(new) - 1
    end = ends[tile]
    second = starts + np.add.reduceat((blocks == i).astype(np.int64), starts) if n else starts
    lo = np.where(i == j, np.arange(n) + 1, second[tile])
    hi = np.where((i == j) | (blocks == i), end, lo)
    return lo, hi


def whole_tiles(batches, columns):
    """Record batches joined so that no tile (equal `columns`) is cut; rows come sorted by them."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if rest.num_rows < 2:
            continue
        same = np.ones(rest.num_rows, dtype=bool)
        for c in columns:
            v = rest.column(c).to_numpy()
            same &= v == v[-1]
        cut = int(np.argmax(same))  # tiles are contiguous: the last one starts here
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _links(batches, radius):
    names = ["mask", "key", "__i", "__j"]
    for t in whole_tiles(batches, names):
        mask, key, i, j, block = (t.column(c).to_numpy() for c in [*names, "__block"])
        fps = t.column("fp").to_numpy().view(np.uint64)
        lo, hi = ranges_of((mask, key), block, i, j)
        a, b = close_pairs(fps, lo, hi, radius)
        label = spanning(len(fps), a, b)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(fps[moved].view(np.int64)), pa.array(fps[label[moved]].view(np.int64))], ["a", "b"]
        )


def links(nodes, radius=RADIUS, tile=TILE):
    """Links (a, b) between the fingerprints of the stored table (fp, ...) that connect all within the radius.

    Of each tile only a spanning forest comes out, never its pairs.
    """
    masks = block_masks(nodes.count(), radius)
    tables = F.explode(F.array(*[
        F.struct(F.lit(t).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)
    ]))
    keyed = nodes.select("fp", tables.alias("t")).select("fp", "t.mask", "t.key")
    tiles = in_tiles(keyed, ["mask", "key"], uniform("fp"), tile)
    order = ["mask", "key", "__i", "__j"]
    dealt = tiles.repartition(*order).sortWithinPartitions(*order, "__block", "fp")
    return dealt.select("fp", *order, "__block").mapInArrow(lambda it: _links(it, radius), "a bigint, b bigint")


def near_duplicates(docs, radius=RADIUS, keep=()):
    """(doc_id, fp, component_id, group, kept columns): linked are fingerprints at `radius` or fewer differing bits.

    group is a number of the component; component_id is the smallest doc_id reachable over links, itself included. Null and
    wordless texts have fingerprint 0 and link like any other; repeated rows and exact
    copies share a fingerprint, which is compared once; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, keep))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = stored(components(links(nodes, radius)).select(F.col("node").alias("fp"), "label"))
    labelled = stored(
        nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    )
    smallest = stored(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    named = stored(labelled.join(smallest, "label").select("fp", F.col("label").alias("group"), "component_id"))
    return prints.join(named, "fp")


def hex_print(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs, radius=RADIUS):
    """One document of each group stays: the one with the smallest doc_id (null last), all columns kept.

    Of rows repeated with the same doc_id and text one stays; of different texts with the
    same smallest doc_id the one with the smaller hash. Null texts are empty, an empty table
    stays empty, and extra columns may have any names.
    """
    mine, nth = fresh("__key", docs), fresh("__n", docs)
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    named = near_duplicates(docs.select("doc_id", "text", key.alias("__key")), radius, ["__key"])
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))
    kept = stored(named.groupBy("group").agg(first.alias("first")).select(F.col("first.__key").alias(mine)))
    one = W.partitionBy(mine).orderBy(mine)
    return (
        docs.select("*", key.alias(mine)).join(kept, mine, "left_semi")
        .withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(docs.columns)
    )
