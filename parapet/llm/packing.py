"""Best-fit packing of documents into sequences of bounded length.

Bulk-synchronous. In a superstep, the documents without a place and the gaps are sorted by
range, numbered, and dealt like cards to cells of bounded size, so that each cell has its share
of every length. A cell sweeps its own sorted documents, longest first: each run of equal
documents is matched with the run of its successor gaps (the smallest that hold it), ranks
inside the run decide who gets which gap, the gaps are updated, and the next run follows.
Then the documents of a cell's emptiest sequences give up their places and go on to the
next superstep, with the next emptiest sequences as gaps; a quarter of the cell's rows at most,
so there are a quarter as many cells each time, and the last superstep has one.
"""

import bisect
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parapet.llm.common import numbered, stored
from parapet.llm.tokens import encoder

CAPACITY = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
CELL = 1 << 15
WAITING, GAP, PLACED = 0, 1, 2


def cut_pieces(docs, path, capacity=CAPACITY, keep_ids=False):
    """Pieces of each document's ids plus the closing id 0; only documents above the capacity
    are cut, into full pieces with the remainder first. A null text is empty: one piece, id 0."""
    schema = PIECES + (", ids binary" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}

    def work(batches):
        encode = encoder(path)
        for batch in batches:
            out = {n: [] for n in names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                start = 0
                end = n % capacity or min(n, capacity)
                piece = 0
                while start < n:
                    part = ids[4 * start : 4 * end]
                    for name, v in zip(names, (doc_id, piece, start, end - start, zlib.crc32(part), part)):
                        out[name].append(v)
                    piece, start, end = piece + 1, end, end + capacity
            yield pa.RecordBatch.from_pydict({n: pa.array(out[n], types[n]) for n in names})

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def sweep(counts, capacity=CAPACITY, rooms=()):
    """Where the documents of each size go: rows (size, first rank, rank after the last,
    first sequence, documents of this size per sequence, offset in the sequence).

    `counts` has the number of documents by size, `rooms` the room of each gap there is, in
    ascending order: those are sequences 0 and up, new ones follow. Longest first, each run
    of documents goes to the smallest gaps that hold it, as many per gap as fit; a new run
    of sequences is opened only when no gap is left. The same packing as best-fit one
    document at a time.
    """
    gaps, runs, moves, opened = [], {}, [], len(rooms)

    def put(gap, first, n):
        if n and gap:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for room, first, n in zip(*(x.tolist() for x in np.unique(np.asarray(rooms, dtype=np.int64), return_index=True, return_counts=True))):
        put(room, first, n)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // size))
                opened += n
            per = gap // size
            full = min(n, left // per)
            if full:
                moves.append((size, rank, rank + full * per, first, per, capacity - gap))
                put(gap - per * size, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < n:
                moves.append((size, rank, rank + left, first + full, left, capacity - gap))
                put(gap - left * size, first + full, 1)
                left, full = 0, full + 1
            put(gap, first + full, n - full)
    return moves


def _cell(key, rows, step, last, capacity, share):
    """One cell's rows after its sweep: documents with their places, and what goes on to the next superstep."""
    order = np.lexsort((rows["__tick"].to_numpy(), rows["length"].to_numpy(), rows["__state"].to_numpy()))
    rows = rows.take(order)
    n = int((rows["__state"].to_numpy() == WAITING).sum())
    docs, gaps = rows.slice(0, n), rows.slice(n)
    length, rooms = docs["length"].to_numpy(), gaps["length"].to_numpy()
    sizes, first, counts = np.unique(length, return_index=True, return_counts=True)
    moves = np.array(sweep(dict(zip(sizes.tolist(), counts.tolist())), capacity, rooms), dtype=np.int64).reshape(-1, 6)
    moves = moves[np.lexsort((moves[:, 1], moves[:, 0]))]
    rank = np.arange(n) - np.repeat(first, counts)
    m = moves[np.searchsorted(moves[:, 0] << 48 | moves[:, 1], length << 48 | rank, side="right") - 1]
    among = rank - m[:, 1]
    sequence, offset = m[:, 3] + among // m[:, 4], m[:, 5] + among % m[:, 4] * length

    total = max(len(rooms), int(sequence.max(initial=-1)) + 1)
    opened = total - len(rooms)
    number = np.concatenate([gaps["sequence_id"].to_numpy(), (step << 56 | key[0].as_py() << 24) + np.arange(opened)])
    room = np.concatenate([rooms, np.full(opened, capacity)]) - np.bincount(sequence, length, total).astype(np.int64)
    state, ongoing = np.full(n, PLACED, dtype=np.int32), np.zeros(0, dtype=np.int64)
    if not last:
        emptiest = np.argsort(-room, kind="stable")
        emptiest = emptiest[room[emptiest] >= capacity // 32]
        new = emptiest[emptiest >= len(rooms)]
        given_up = new[np.cumsum(np.bincount(sequence, minlength=total)[new]) <= share]
        state[np.isin(sequence, given_up)] = WAITING
        ongoing = emptiest[~np.isin(emptiest, given_up)][:share]
    columns = {"sequence_id": number[sequence], "offset": offset, "__tick": docs["__tick"], "__state": state}
    for name, values in columns.items():
        docs = docs.set_column(docs.column_names.index(name), docs.schema.field(name), pa.chunked_array([values]) if isinstance(values, np.ndarray) else values)
    kept = {"length": room[ongoing], "sequence_id": number[ongoing], "offset": capacity - room[ongoing],
            "__tick": np.arange(len(ongoing)) / max(1, len(ongoing)), "__state": np.full(len(ongoing), GAP, dtype=np.int32)}
    left = [pa.array(kept[f.name], f.type) if f.name in kept else pa.nulls(len(ongoing), f.type) for f in docs.schema]
    return pa.concat_tables([docs, pa.table(left, schema=docs.schema)])


def superstep(rows, cells, step, capacity=CAPACITY, share=CELL // 8):
    """Documents and gaps dealt to cells and swept there; the last superstep, of one cell, places all."""
    schema = rows.schema
    names = rows.columns
    if cells > 1:
        rows = numbered(rows, ["__state", "length", "__tick"], "__n").withColumn("__cell", F.col("__n") % cells)
    else:
        rows = rows.withColumn("__cell", F.lit(0).cast("bigint"))

    def work(key, table):
        return _cell(key, table.select(names), step, cells == 1, capacity, share)

    return rows.groupBy("__cell").applyInArrow(work, schema)


def pack(docs, path, capacity=CAPACITY, keep_ids=False, cell=CELL):
    """Every document's pieces with their sequence and offset there; no sequence is longer than the capacity.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids as
    little-endian unsigned 32-bit numbers with `keep_ids`). A cell has about `cell` pieces.
    Repeated rows are packed each and ties are ordered by random numbers that are stored with
    the pieces, so equal rows are dealt apart; an empty table gives no rows.
    """
    rows = stored(cut_pieces(docs, path, capacity, keep_ids).select(
        "*", F.lit(-1).cast("bigint").alias("sequence_id"), F.lit(-1).cast("bigint").alias("offset"),
        F.rand(7).alias("__tick"), F.lit(WAITING).alias("__state"),
    ))
    placed, step = [], 0
    while (cells := -(-rows.count() // cell)) > 1:
        done = stored(superstep(rows, cells, step, capacity, cell // 8))
        placed.append(done.where(F.col("__state") == PLACED))
        rows, step = done.where(F.col("__state") != PLACED), step + 1
    placed.append(superstep(rows, 1, step, capacity))
    return functools.reduce(lambda a, b: a.unionByName(b), placed).drop("__tick", "__state")
