"""Document fingerprints: a Merkle tree over sections, paragraphs and sentence pieces."""

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F


LEAF = re.compile(rb"[^.!?;|]{1,256}[.!?;|]*|[.!?;|]+")
LEAF_BYTES = 6
NODE_BYTES = 8
ROOT_BYTES = 16
SECTION_BITS = 3
REMEMBERED = 20_000


def _hash(data, size):
    return hashlib.blake2b(data, digest_size=size).digest()


class Tree:
    """Sections of paragraphs of leaves. A section ends with a paragraph whose hash has SECTION_BITS
    zero bits, so an edit moves no border but its own; leaves are pieces of a line that end
    with punctuation, of 256 bytes at most."""

    def __init__(self, data, memo):
        self.sections, paragraphs = [], []
        for line in data.split(b"\n"):
            known = memo.get(line)
            if known is None:
                leaves = [_hash(x, LEAF_BYTES) for x in LEAF.findall(line)]
                known = _hash(b"".join(leaves), NODE_BYTES), leaves
                if len(memo) >= REMEMBERED:
                    memo.clear()
                memo[line] = known
            paragraphs.append(known)
            if known[0][0] >> (8 - SECTION_BITS) == 0:
                self._close(paragraphs)
                paragraphs = []
        if paragraphs:
            self._close(paragraphs)
        self.root = _hash(b"".join(s for s, _ in self.sections), ROOT_BYTES)
        self.leaves = Counter(x for _, ps in self.sections for _, leaves in ps for x in leaves)

    def _close(self, paragraphs):
        self.sections.append((_hash(b"".join(p for p, _ in paragraphs), NODE_BYTES), paragraphs))

    def text(self):
        """root=section:paragraph:leaf,leaf;paragraph:...|section:... in hex."""
        row = lambda p: p[0].hex() + ":" + ",".join(x.hex() for x in p[1])
        return self.root.hex() + "=" + "|".join(s.hex() + ":" + ";".join(map(row, ps)) for s, ps in self.sections)


def likeness(a, b):
    """Share of equal leaves, twice the common ones over all; 1 for equal roots, 0 for nothing common."""
    if a.root == b.root:
        return 1.0
    n = a.leaves.total() + b.leaves.total()
    small, large = sorted((a.leaves, b.leaves), key=len)
    return 2.0 * sum(min(k, large[x]) for x, k in small.items() if x in large) / n if n else 0.0


def parse(fingerprint):
    """(root, [(section, [(paragraph, [leaf])])]) of a fingerprint string."""
    root, _, rest = fingerprint.partition("=")
    sections = []
    for part in rest.split("|"):
        section, _, paragraphs = part.partition(":")
        rows = [p.partition(":") for p in paragraphs.split(";")]
        sections.append((section, [(p, leaves.split(",") if leaves else []) for p, _, leaves in rows]))
    return root, sections


def edited_branches(before, after):
    """(section, paragraph) numbers of `after` that `before` does not have; equal branches are skipped whole."""
    (root, old), (new_root, new) = parse(before), parse(after)
    if root == new_root:
        return []
    sections = {s for s, _ in old}
    paragraphs = {p for _, ps in old for p, _ in ps}
    return [
        (i, j) for i, (s, ps) in enumerate(new) if s not in sections for j, (p, _) in enumerate(ps) if p not in paragraphs
    ]


def _bucket(column, bounds):
    """Number of bounds at or below the column, looked up in two levels."""
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not groups:
        return F.lit(0)
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= column))
    coarse = F.greatest(below(longs([g[0] for g in groups])) - 1, F.lit(0))
    return coarse * width + below(F.get(F.array(*[longs(g) for g in groups]), coarse))


def in_order(docs):
    """Documents dealt to buckets of ascending doc_id, each with the document that follows its last one.

    Adds __bucket, __tail (1 for the following document) and __order. After the last
    document comes the first. The borders are quantiles; driver and broadcast hold a row
    per bucket. Null ids come last; rows with one id are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), order.alias("__order"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = docs.select(F.col("doc_id").cast("bigint").alias("id")).approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n)
    bounds = sorted({int(x) for x in quantiles if abs(x) < 2**62})
    docs = docs.withColumn("__bucket", _bucket(F.col("__order"), bounds))
    firsts = sorted(map(tuple, docs.groupBy("__bucket").agg(F.min("__order")).collect()))
    own = docs.withColumn("__tail", F.lit(0))
    if not firsts:
        return own
    follows = [F.struct(F.lit(b).alias("__for"), F.lit(o).cast("bigint").alias("__first"))
               for (b, _), (_, o) in zip(firsts, [*firsts[1:], firsts[0]])]
    heads = spark.range(0, 1, 1, 1).select(F.inline(F.array(*follows)))
    tails = docs.join(F.broadcast(heads), F.col("__order") == F.col("__first")).select(
        "doc_id", "text", "__order", F.col("__for").alias("__bucket"), F.lit(1).alias("__tail")
    )
    return own.unionByName(tails)


def _pairs(batches):
    """(row, following row) of the sorted buckets; each is (doc_id, text, bucket, tail)."""
    last = None
    for batch in batches:
        columns = [batch.column(c) for c in ("doc_id", "text", "__bucket", "__tail")]
        for row in zip(*columns):
            row = tuple(x.as_py() for x in row)
            if last is not None and last[2] == row[2] and not last[3]:
                yield last, row
            last = row


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _fingerprinted(batches):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows, size, memo, ahead = [], 0, {}, None
    out = lambda: pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows))}, schema=_arrow())
    for (doc_id, text, *_), following in _pairs(batches):
        tree = ahead[1] if ahead and ahead[0] == text else Tree(text.encode(), memo)
        next_tree = Tree(following[1].encode(), memo)
        n = len(text)
        edited = (text[: n - n // 2] + following[1][: n // 2]).encode()
        new = Tree(edited, memo)
        rows.append((
            doc_id, n, hashlib.sha256(edited).hexdigest(), tree.text(), new.text(), likeness(tree, new), likeness(tree, next_tree)
        ))
        ahead = following[1], next_tree
        size += len(text)
        if size > 4_000_000:
            yield out()
            rows, size = [], 0
    if rows:
        yield out()


def _arrow():
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def fingerprints(docs):
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next document's. A null text is empty; an empty text's tree has one empty
    paragraph; a single document is followed by itself; repeated rows follow one another.
    Whole texts travel once, to buckets of neighbouring ids; a task holds two texts.
    """
    ordered = in_order(docs)
    dealt = ordered.repartition("__bucket").sortWithinPartitions("__bucket", "__tail", "__order", F.xxhash64("text"))
    return dealt.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "__bucket", "__tail").mapInArrow(
        _fingerprinted, SCHEMA
    )
