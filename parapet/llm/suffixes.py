"""Removal of repeated passages by a logarithmic family of sparse suffix arrays.

Every window of LENGTH bytes names one suffix, the one that starts at its least hashed gram
(leftmost of equals), so equal windows name equal suffixes at the same distance. Only named
suffixes are indexed, each with the run of windows that name it. The index is dealt to
buckets by gram; inside a bucket, batches of documents come in the order of doc_id: a batch
gets a sorted suffix array, is merge-scanned against the levels before it, and becomes a
level; levels of equal size merge. Suffixes whose whole run of windows is equal match at
once. Where grams are equal and runs differ, their windows are compared one by one.

No group is held whole by one task because its gram is common: grams that a sample shows
to be hot are scanned in parts by their run, and buckets with many windows to compare are
cut by window hash, where the first document of each window is found before the windows come.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from parapet.llm.common import place, stored, uniform

LENGTH = 50
GRAM = 20
CHUNK = 1 << 18
BATCHES = 16
BUCKET_BYTES = 1 << 23
FLUSH = 1 << 17
HOT_SUFFIXES = 1 << 18
HOT_TIMES = 4
LEAST_HOT = 1 << 15
SAMPLED = 64
TAG = 32  # a position carries in its upper bits which of several rows with one doc_id is meant
U = np.uint64
_ODD = np.random.default_rng(20_240).integers(1, 2**63, 32, dtype=np.uint64) * U(2) + U(1)


def _words(data):
    """At each position the following eight bytes as a number, mixed."""
    n = len(data) - 7
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    out = np.empty(-(-n // 8) * 8, dtype=np.uint64)
    for i in range(8):
        out[i::8] = padded[i : i + len(out)].view(np.uint64) if (len(padded) - i) >= len(out) else 0
    out = out[:n]
    out *= _ODD[0]
    out ^= out >> U(32)
    return out


def _steps(length):
    """Offsets of eight-byte words that cover `length` bytes."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def _hash_at(words, at, length, first):
    total = np.zeros(len(at), dtype=np.uint64)
    for k, step in enumerate(_steps(length)):
        total += words[at + step] * _ODD[first + k]
    total ^= total >> U(31)
    total *= _ODD[first]
    return total ^ (total >> U(29))


def window_hashes(words, at):
    """Two independent 64-bit hashes of the windows at the positions."""
    return _hash_at(words, at, LENGTH, 8), _hash_at(words, at, LENGTH, 18)


def _grams(words, n):
    total = np.zeros(n, dtype=np.uint64)
    for k, step in enumerate(_steps(GRAM)):
        total += words[step : step + n] * _ODD[1 + k]
    total ^= total >> U(31)
    total *= _ODD[5]
    return total ^ (total >> U(29))


def _least(grams, width):
    """Distance from each window's start to its least gram, the leftmost of equals."""
    least, off, have = grams, np.zeros(len(grams), dtype=np.uint8), 1

    def join(step):
        right = least[step:]
        left = least[: len(right)]
        later = right < left
        return np.where(later, right, left), np.where(later, off[step:] + np.uint8(step), off[: len(right)])

    while 2 * have <= width:
        least, off = join(have)
        have *= 2
    if have < width:
        least, off = join(width - have)
    return off


def named_suffixes(data, ends, stop):
    """Suffixes named by the windows that start before `stop`: (gram hash, run hash, first window, windows after it).

    `ends[p]` is where the document of position p ends; no window crosses it.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    words = _words(data)
    grams = _grams(words, len(data) - GRAM + 1)
    named = np.arange(n) + _least(grams, LENGTH - GRAM + 1)[:n]
    at = np.arange(n)
    good = (at + LENGTH <= ends[:n]) & (at < stop)
    new = good.copy()
    new[1:] &= ~good[:-1] | (named[1:] != named[:-1])
    first = np.flatnonzero(new)
    last_good = good.copy()
    last_good[:-1] &= ~good[1:] | (named[1:] != named[:-1])
    last = np.flatnonzero(last_good)
    gram = grams[named[first]] * _ODD[28]
    gram ^= gram >> U(32)
    run = window_hashes(words, first)[0] * _ODD[29] + window_hashes(words, last)[1] * _ODD[30]
    run += ((last - first).astype(np.uint64) << U(8) | (named[first] - first).astype(np.uint64)) * _ODD[31]
    run ^= run >> U(32)
    return gram, run * _ODD[27], first, last - first


def _buffer(column):
    """Bytes and offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _planes(values):
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _packed(keys, docs, at, more):
    """Suffixes of one bucket and batch as compressed byte planes."""
    moves = np.diff(docs, prepend=np.int64(0))
    raw = _planes(keys) + _planes(moves) + _planes(at) + more.astype(np.uint8).tobytes()
    return zstandard.compress(raw, 1)


def _unpacked(blob):
    raw = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
    n = len(raw) // 25
    column = lambda i, kind: np.ascontiguousarray(raw[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view(kind).reshape(n)
    return column(0, np.uint64), np.cumsum(column(1, np.int64)), column(2, np.int64), raw[24 * n :].astype(np.int64)


def _named_by_chunk(data, offsets):
    """Suffixes named in a column of documents: (gram hash, run hash, document, first window in it, windows after it)."""
    for lo in range(0, len(data), CHUNK):
        hi = min(lo + CHUNK, len(data))
        part = data[lo : min(hi + LENGTH - 1, len(data))]
        doc = np.searchsorted(offsets, np.arange(lo, lo + len(part)), side="right") - 1
        gram, run, at, more = named_suffixes(part, offsets[doc + 1] - lo, hi - lo)
        if len(at):
            own = doc[at]
            yield gram, run, own, at + lo - offsets[own], more


def _gram_counts(batches):
    for b in batches:
        found = [x[0] for x in _named_by_chunk(*_buffer(b.column(0)))]
        gram, n = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])


def hot_grams(marked, limit, sampled):
    """(grams, parts): grams whose suffixes, carried on from a sample of the documents, exceed the limit, sorted, and into how many parts each is cut."""
    sample = marked.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sampled)) == 0).select("text")
    counts = sample.mapInArrow(_gram_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") * sampled > limit).collect()
    grams, n = np.array([r["gram"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in rows], dtype=np.int64)
    order = np.argsort(grams)
    return grams[order], -(-n[order] * sampled // limit)


def _suffix_batches(batches, buckets, bounds, hot):
    """Rows (bucket, part, batch, suffixes): what the documents read give to each bucket and batch of ids.

    Part is 0, or that of a hot gram.
    """
    grams, parts = hot

    def part_of(gram, run):
        if not len(grams):
            return np.zeros(len(gram), dtype=np.int32)
        i = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
        return np.where(grams[i] == gram, 1 + (run % parts[i].astype(np.uint64)).astype(np.int64), 0).astype(np.int32)

    kept, size = [], 0

    def flush():
        gram, run, docs, at, more = (np.concatenate(x) for x in zip(*kept))
        bucket = (gram % U(buckets)).astype(np.int64)
        batch = np.searchsorted(bounds, docs, side="right")
        part = part_of(gram, run)
        keys = (gram // U(buckets)) << U(40) | run >> U(24)
        order = np.lexsort((at, docs, batch, part, bucket))
        bucket, part, batch, keys, docs, at, more = (x[order] for x in (bucket, part, batch, keys, docs, at, more))
        cut = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (batch[1:] != batch[:-1])])
        ends = np.r_[cut[1:], len(bucket)]
        blobs = [_packed(keys[a:b], docs[a:b], at[a:b], more[a:b]) for a, b in zip(cut, ends)]
        return pa.RecordBatch.from_arrays(
            [pa.array(x[cut].astype(np.int32)) for x in (bucket, part, batch)] + [pa.array(blobs, pa.binary())],
            ["bucket", "part", "batch", "suffixes"],
        )

    for b in batches:
        ids, tags = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        data, offsets = _buffer(b.column(2))
        for gram, run, own, at, more in _named_by_chunk(data, offsets):
            kept.append((gram, run, ids[own].astype(np.int64), at | tags[own].astype(np.int64) << TAG, more))
            size += len(at)
            if size >= FLUSH:
                yield flush()
                kept, size = [], 0
    if size:
        yield flush()


class Level:
    """A sorted suffix array: keys (gram, run), and of each run the first document that has it."""

    def __init__(self, keys, docs, at, more, asked, size):
        self.keys, self.docs, self.at, self.more, self.asked, self.size = keys, docs, at, more, asked, size

    def merged(self, other):
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        pick = lambda a, b: np.concatenate([a, b])[order]
        return Level(
            keys[order], pick(self.docs, other.docs), pick(self.at, other.at), pick(self.more, other.more),
            pick(self.asked, other.asked), self.size + other.size,
        )


class Family:
    """Levels of a bucket. `add` takes the suffixes of the next batch, whose documents all come after the earlier ones."""

    def __init__(self):
        self.levels = []

    def add(self, keys, docs, at, more, hot=False):
        """(whole, ask): suffixes whose whole run an earlier document has, and those to compare window by window,
        each as (docs, at, more, grams). Of hot grams other parts have runs too: each first one is compared."""
        order = np.lexsort((at, docs, keys))
        keys, docs, at, more = keys[order], docs[order], at[order], more[order]
        start = np.r_[True, keys[1:] != keys[:-1]]
        of = np.cumsum(start) - 1
        ukeys, least = keys[start], docs[start]
        known = np.zeros(len(ukeys), dtype=bool)
        gram = ukeys >> U(40)
        related = np.zeros(len(ukeys), dtype=bool)
        asks = []
        spans = []
        for level in self.levels:
            i = np.minimum(np.searchsorted(level.keys, ukeys), len(level.keys) - 1)
            known |= level.keys[i] == ukeys
            a, b = np.searchsorted(level.keys, gram << U(40)), np.searchsorted(level.keys, (gram << U(40)) + U((1 << 40) - 1), side="right")
            spans.append((a, b))
            related |= b > a
        whole = known[of] | (docs > least[of])
        first = ~known
        # Other runs of the gram in this batch, in another document.
        g_start = np.r_[True, gram[1:] != gram[:-1]]
        g_of = np.cumsum(g_start) - 1
        at_g = np.flatnonzero(g_start)
        low = np.minimum.reduceat(np.where(first, least, np.iinfo(np.int64).max), at_g)
        high = np.maximum.reduceat(np.where(first, least, np.iinfo(np.int64).min), at_g)
        ask = first & (hot | related | (low < high)[g_of])
        for level, (a, b) in zip(self.levels, spans):
            wanted = np.zeros(len(level.keys) + 1, dtype=np.int64)
            np.add.at(wanted, a[ask], 1)
            np.add.at(wanted, b[ask], -1)
            wanted = (np.cumsum(wanted)[:-1] > 0) & ~level.asked
            level.asked |= wanted
            asks.append((level.docs[wanted], level.at[wanted], level.more[wanted], level.keys[wanted] >> U(40)))
        stays = first[of] & (docs == least[of])
        own = stays & ask[of]
        asks.append((docs[own], at[own], more[own], keys[own] >> U(40)))
        if stays.any():
            level = Level(keys[stays], docs[stays], at[stays], more[stays], ask[of][stays], 1)
            while self.levels and self.levels[-1].size <= level.size:
                level = self.levels.pop().merged(level)
            self.levels.append(level)
        return (docs[whole], at[whole], more[whole], keys[whole] >> U(40)), tuple(np.concatenate(x) for x in zip(*asks))


def _scanned(batches):
    """Matches and questions of sorted rows (bucket, part, batch, suffixes), as rows (doc_id, at, more, bucket, gram).

    Of a match, which needs no comparison, bucket and gram are -1.
    """

    def out(parts, ask):
        docs, at, more, gram = parts
        own = np.full(len(docs), bucket if ask else -1, dtype=np.int32)
        gram = gram.astype(np.int32) if ask else own
        return pa.RecordBatch.from_arrays(
            [pa.array(docs), pa.array(at), pa.array(more.astype(np.int32)), pa.array(own), pa.array(gram)],
            ["doc_id", "at", "more", "bucket", "gram"],
        )

    family, bucket, part, batch, waiting = Family(), None, None, None, []

    def close():
        whole, ask = family.add(*(np.concatenate(x) for x in zip(*map(_unpacked, waiting))), hot=part > 0)
        return [r for r in (out(whole, False), out(ask, True)) if r.num_rows]

    for rows in batches:
        for b, p, r, blob in zip(*(rows.column(i).to_pylist() for i in range(3)), rows.column(3)):
            if (b, p, r) != (bucket, part, batch):
                if waiting:
                    yield from close()
                    waiting = []
                if (b, p) != (bucket, part):
                    family = Family()
                bucket, part, batch = b, p, r
            waiting.append(blob.as_py())
    if waiting:
        yield from close()


def _compressed(batches):
    for b in batches:
        data, offsets = _buffer(b.column(2))
        packer = zstandard.ZstdCompressor(level=1)
        blobs = [packer.compress(data[x:y].tobytes()) for x, y in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], ["doc_id", "tag", "text"])


def _text(blob):
    return np.frombuffer(zstandard.decompress(blob.as_py()), dtype=np.uint8)


def _windows(batches, parts):
    """Hashes of the asked windows, packed by bucket and part of it: rows (bucket, part, kind, windows).

    A bucket b is cut by window hash into parts[b]. Where that is several, rows of kind 0 come
    before the windows themselves: each distinct window with its smallest document, as far as known here.
    """
    kept, size = [], 0

    def packed(gram, hashes, docs, at):
        moves = [np.diff(v, prepend=v.dtype.type(0)) for v in (gram, docs, at)]
        return zstandard.compress(b"".join(_planes(v) for v in moves) + _planes(hashes)[: 6 * len(gram)], 1)

    def rows_of(kind, bucket, part, *columns):
        cut = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
        for x, y in zip(cut, np.r_[cut[1:], len(bucket)]):
            yield bucket[x], part[x], kind, packed(*(v[x:y] for v in columns))

    def flush():
        bucket, gram, hashes, docs, at = (np.concatenate(x) for x in zip(*kept))
        many = parts[bucket]
        part = np.where(many > 1, 1 + (hashes % many.astype(np.uint64)).astype(np.int64), 0)
        order = np.lexsort((at, docs, gram, part, bucket))
        columns = [x[order] for x in (bucket, part, gram, hashes, docs, at)]
        rows = list(rows_of(1, *columns))
        cut = [x[columns[1] > 0] for x in columns]
        if len(cut[0]):
            bucket, part, gram, hashes, docs, at = cut
            order = np.lexsort((docs, hashes, gram, part, bucket))
            bucket, part, gram, hashes, docs = (x[order] for x in (bucket, part, gram, hashes, docs))
            new = np.r_[True, np.any([x[1:] != x[:-1] for x in (bucket, gram, hashes)], axis=0)]
            first = [x[new] for x in (bucket, part, gram, hashes, docs)]
            rows += rows_of(0, *first, np.zeros(len(first[0]), dtype=np.int64))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "part", "kind", "windows"])

    for b in batches:
        for doc, tag, blob, *asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(b.column(i) for i in range(2, 7))):
            first, more, bucket, gram = (np.array(x.as_py()) for x in asked)
            many = more + 1
            at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            hashes = window_hashes(_words(_text(blob)), at)[0]
            kept.append((
                np.repeat(bucket, many).astype(np.int32), np.repeat(gram, many).astype(np.int32), hashes,
                np.full(len(at), doc, dtype=np.int64), at.astype(np.int64) | tag << TAG,
            ))
            size += len(at)
            if size >= FLUSH:
                yield flush()
                kept, size = [], 0
    if size:
        yield flush()


def _unpacked_windows(blob):
    """(window, docs, at): a window's number is its hash and the lower half of its gram."""
    raw = np.frombuffer(zstandard.decompress(blob.as_py()), dtype=np.uint8)
    n = len(raw) // 26
    column = lambda lo, width, kind: np.ascontiguousarray(raw[lo * n : (lo + width) * n].reshape(width, n).T).view(kind).reshape(n)
    gram = np.cumsum(column(0, 4, np.int32), dtype=np.int32).astype(np.uint64) & U(0xFFFF)
    low, high = column(20, 4, np.uint32), column(24, 2, np.uint16)
    window = low.astype(np.uint64) | high.astype(np.uint64) << U(32) | gram << U(48)
    return window, np.cumsum(column(4, 8, np.int64)), np.cumsum(column(12, 8, np.int64))


def _first_documents(window, docs):
    """Distinct windows, sorted, and the smallest document of each."""
    order = np.lexsort((docs, window))
    window, docs = window[order], docs[order]
    new = np.r_[True, window[1:] != window[:-1]]
    return window[new], docs[new]


def _earlier(window, docs, at, known):
    """Windows that an earlier document has too by the table `known`, as (docs, at, more)."""
    later = docs > known[1][np.searchsorted(known[0], window)]
    docs, at = docs[later], at[later]
    order = np.lexsort((at, docs))
    docs, at = docs[order], at[order]
    new = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (at[1:] != at[:-1] + 1)]) if len(docs) else np.zeros(0, dtype=np.int64)
    return docs[new], at[new], np.diff(np.r_[new, len(docs)]) - 1


def _compared(batches):
    """Rows (doc_id, at, more) of sorted rows (bucket, part, kind, windows).

    A bucket in one part is held whole. Of a part, only the table of its distinct windows is
    held; the windows pass by it.
    """
    of, waiting, known = None, [], None

    def table():
        window, docs, at = (np.concatenate(x) for x in zip(*map(_unpacked_windows, waiting)))
        return _first_documents(window, docs), (window, docs, at)

    def out(rows, known):
        docs, at, more = _earlier(*rows, known)
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(at), pa.array(more.astype(np.int32))], ["doc_id", "at", "more"])

    for rows in batches:
        for b, p, kind, blob in zip(*(rows.column(i).to_pylist() for i in range(3)), rows.column(3)):
            if (b, p) != of:
                if waiting:
                    first, held = table()
                    yield out(held, first)
                of, waiting, known = (b, p), [], None
            if p and kind:
                if known is None:
                    known, waiting = table()[0], []
                yield out(_unpacked_windows(blob), known)
            else:
                waiting.append(blob)
    if waiting:
        first, held = table()
        yield out(held, first)


def covered_runs(first, more):
    """Maximal runs (from, to) of bytes covered by the windows first .. first + more."""
    order = np.argsort(first, kind="stable")
    lo, hi = first[order], np.maximum.accumulate((first + more + LENGTH)[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]]


def _kept(batches, texts):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    for b in batches:
        rows = []
        for doc, blob, first, more in zip(b.column(0).to_pylist(), *(b.column(i) for i in (1, 2, 3))):
            data, spans, kept = _text(blob), 0, None
            if first.is_valid:
                lo, hi = covered_runs(np.array(first.as_py(), dtype=np.int64), np.array(more.as_py(), dtype=np.int64))
                spans = len(lo)
                kept = b"".join(data[x:y].tobytes() for x, y in zip(np.r_[0, hi], np.r_[lo, len(data)]))
            else:
                kept = data.tobytes()
            rows.append((doc, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds[: len(names)]], names)


def _by_document(rows, *more):
    """Runs of windows as arrays of a row per document."""
    at = F.col("at").bitwiseAND((1 << TAG) - 1).alias("at")
    return rows.select("doc_id", F.shiftright("at", TAG).cast("int").alias("tag"), at, "more", *more).groupBy("doc_id", "tag").agg(
        *[F.collect_list(c).alias(c) for c in ("at", "more", *more)]
    )


def _window_parts(found, buckets):
    """Into how many parts the asked windows of each bucket are cut: several where it has HOT_TIMES the mean, which BUCKET_BYTES bounds."""
    rows = found.where("bucket >= 0").groupBy("bucket").agg(F.sum(F.col("more").cast("bigint") + 1).alias("n")).collect()
    n = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        n[r["bucket"]] = r["n"]
    return -(-n // max(LEAST_HOT, int(HOT_TIMES * n.mean())))


def _numbered_texts(read, repeated):
    """The rows of repeated ids with the number (from 1) of their text among the different texts of the id."""
    rows = read.join(repeated, F.col("doc_id") == F.col("__id"), "left_semi").withColumn("__sha", F.sha2("text", 256))
    texts = stored(rows.select("doc_id", "__sha").distinct().withColumn("__tick", uniform("__sha")))
    numbers = place(texts, ["doc_id"], "__tick", ["__sha"])
    numbers = stored(numbers.select("doc_id", "__sha", (F.col("__rank") + 1).cast("int").alias("tag")))
    return rows.join(numbers, ["doc_id", "__sha"]).select("doc_id", "tag", "text")


def remove_repeats(docs, batches=BATCHES, texts=False):
    """Each document without the bytes of LENGTH-byte strings that start in a document with a smaller doc_id.

    Columns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (and
    `kept`, the bytes left, with `texts`). Null texts are empty. Rows with equal doc_id do
    not count as earlier than each other; rows whose doc_id is null keep everything and
    count for no other. Texts shorter than LENGTH bytes keep everything.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = stored(read.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__id")))
    total = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marked = read.withColumn("tag", F.lit(0))
    if not repeated.isEmpty():
        once = marked.join(repeated, F.col("doc_id") == F.col("__id"), "left_anti")
        marked = once.select("doc_id", "tag", "text").unionByName(_numbered_texts(read, repeated))
    marked = marked.select("doc_id", "tag", "text")
    quantiles = read.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = sorted({int(x) for x in quantiles if abs(x) < 2**62})
    bounds = np.array(bounds, dtype=np.int64)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    named = marked.where("doc_id is not null")
    hot = hot_grams(named, HOT_SUFFIXES, SAMPLED)
    suffixes = named.mapInArrow(
        lambda it: _suffix_batches(it, buckets, bounds, hot), "bucket int, part int, batch int, suffixes binary"
    )
    dealt = suffixes.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "batch")
    found = stored(dealt.mapInArrow(_scanned, "doc_id bigint, at bigint, more int, bucket int, gram int"))
    # One shuffle of the texts serves both joins; the filter is what the inner join would add.
    pack = lambda rows: rows.mapInArrow(_compressed, "doc_id bigint, tag int, text binary")
    packed = pack(marked).where("doc_id is not null and tag is not null").repartition("doc_id", "tag")
    asked = packed.join(_by_document(found.where("bucket >= 0"), "bucket", "gram"), ["doc_id", "tag"])
    parts = _window_parts(found, int(buckets))
    windows = asked.mapInArrow(lambda it: _windows(it, parts), "bucket int, part int, kind int, windows binary")
    windows = windows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    later = windows.mapInArrow(_compared, "doc_id bigint, at bigint, more int")
    ranges = _by_document(found.where("bucket < 0").select("doc_id", "at", "more").unionByName(later))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if texts else "")
    known = packed.join(ranges, ["doc_id", "tag"], "left").select("doc_id", "text", "at", "more")
    nothing = [F.lit(None).cast("array<bigint>").alias("at"), F.lit(None).cast("array<int>").alias("more")]
    unnamed = pack(marked.where("doc_id is null")).select("doc_id", "text", *nothing)
    return known.unionByName(unnamed).mapInArrow(lambda it: _kept(it, texts), schema)
