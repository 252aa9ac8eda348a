"""Spelling variants: words one edit apart by a variable-length gram index.

A gram dictionary is pruned by frequency: a gram that few words hold is not made longer, so
from each place of a word runs the shortest gram that is rare (or the longest allowed). One
edit can touch only the grams that cover one place; a word's bound is the most grams that
do. Two words one edit apart share all others, so each needs to enter the lists of its
rarest grams only, one more than its bound, and the lists' words are verified in their list.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parapet.llm.common import in_tiles, let, stored, uniform
from parapet.llm.simhash import whole_tiles

MIN_LENGTH = 6
MIN_COUNT = 5
DROP_ONE_IN = 199
SHORTEST, RARE = 2, 64
END = "$"  # no letter; closes a word, so that grams know the end
TILE = 512
RATIO = 5
BLOCK = 1 << 24  # bytes compared at a time
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def longest_gram(min_length=MIN_LENGTH):
    """With grams below the shortest word's length, some gram of every word escapes any one edit."""
    return min_length - 1


def damaged_words(docs, min_length=MIN_LENGTH):
    """(word, n): the runs of letters of all texts, lower-cased, some with a letter dropped, and how often each occurs.

    A run shorter than min_length cannot become a word, so it is never made a row. Null texts
    have no words; repeated rows count each; other columns do not matter.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    hit = rows.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.left("run", at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DROP_ONE_IN == 0, shorter).otherwise(F.col("run"))
    return hit.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def gram_rows(words, longest):
    """(word_id, size, at, length, gram): every gram of every word, closed by the end mark, of the allowed lengths."""
    closed = F.concat("word", F.lit(END))
    size = F.length("word")
    places = words.select("word_id", closed.alias("closed"), size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    most = F.least(F.lit(longest), F.col("size") + 1 - F.col("at"))
    lengths = places.select("*", F.explode(F.sequence(F.lit(SHORTEST), most)).alias("length"), most.alias("most"))
    return lengths.select("word_id", "size", "at", "length", (F.col("length") == F.col("most")).alias("last"), F.substr("closed", F.col("at") + 1, F.col("length")).alias("gram"))


def dictionary(words, longest):
    """(gram, held): the grams that may be used, with how many places hold them."""
    return gram_rows(words, longest).groupBy("gram").agg(F.count(F.lit(1)).alias("held"))


def decompose(words, grams, longest, rare=RARE):
    """(word_id, size, tokens): the gram from each place, the shortest that is rare or the longest there is.

    tokens is array<struct<held, gram, at, length>>, the rarest first.
    """
    usable = gram_rows(words, longest).join(grams, "gram").where((F.col("held") <= rare) | F.col("last"))
    chosen = usable.groupBy("word_id", "size", "at").agg(F.min(F.struct("length", "held", "gram")).alias("g"))
    token = F.struct(F.col("g.held").alias("held"), F.col("g.gram").alias("gram"), F.col("at"), F.col("g.length").alias("length"))
    return chosen.groupBy("word_id", "size").agg(F.sort_array(F.collect_list(token)).alias("tokens"))


def affected(tokens, size, longest):
    """The most grams that one edit can touch: those that cover a place (the end counts for insertions behind the word)."""
    by_place = F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct(t["at"].alias("at"), t["length"].alias("length")))), lambda t: t["length"])
    covers = lambda lengths, i: sum(
        (F.when(F.coalesce(F.get(lengths, i - back), F.lit(0)) > back, 1).otherwise(0) for back in range(longest)), F.lit(0)
    )
    return let(by_place, lambda lengths: F.array_max(F.transform(F.sequence(F.lit(0), size), lambda i: covers(lengths, i))))


def postings(decomposed, longest):
    """(gram, time, word_id): each word under its rarest grams, one more than an edit can touch; `time` numbers equal grams of a word."""
    kept = F.slice("tokens", F.lit(1), affected(F.col("tokens"), F.col("size"), longest) + 1)
    numbered = let(kept, lambda k: F.transform(k, lambda t, i: F.struct(
        t["gram"].alias("gram"), F.size(F.filter(F.slice(k, F.lit(1), i), lambda u: u["gram"] == t["gram"])).alias("time")
    )))
    return decomposed.select("word_id", F.inline(numbered))


def near_pairs(words):
    """(i, j), i < j: words one inserted, deleted or replaced letter apart; words are Latin-1 bytes.

    Words are compared by length: equal ones letter by letter, and each length with the next
    by their common beginning and end.
    """
    sizes = np.array([len(w) for w in words])
    found = []
    table = {s: (np.flatnonzero(sizes == s), None) for s in np.unique(sizes)}
    table = {s: (rows, np.frombuffer(b"".join(words[i] for i in rows), dtype=np.uint8).reshape(len(rows), s)) for s, (rows, _) in table.items()}
    for s, (rows, a) in table.items():
        step = max(1, BLOCK // max(1, a.size))
        for lo in range(0, len(rows), step):
            p, q = np.nonzero((a[lo : lo + step, None] != a[None]).sum(axis=2) == 1)
            found.append((rows[p + lo], rows[q]))
        if s + 1 in table:
            longer, b = table[s + 1]
            for lo in range(0, len(rows), max(1, BLOCK // max(1, b.size))):
                part = a[lo : lo + max(1, BLOCK // max(1, b.size)), None]
                begin = np.minimum.accumulate(part == b[None, :, :-1], axis=2).sum(axis=2)
                end = np.minimum.accumulate((part == b[None, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
                p, q = np.nonzero(begin + end >= s)
                found.append((rows[p + lo], longer[q]))
    pairs = {(min(i, j), max(i, j)) for x, y in found for i, j in zip(x.tolist(), y.tolist())}
    return sorted(pairs)


def _verified(batches):
    """Both directions of the near pairs of every list; of a cut list, each pair of blocks meets in one tile."""
    names = ["gram", "time", "__i", "__j"]
    for t in whole_tiles(batches, names):
        keys = [t.column(c).to_numpy() for c in names]
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        first = np.flatnonzero(new)
        word, n, block = t.column("word").to_pylist(), t.column("n").to_numpy(), t.column("__block").to_numpy()
        encoded = [w.encode("latin-1") for w in word]
        rows = []
        for lo, hi in zip(first, np.append(first[1:], t.num_rows)):
            if hi - lo < 2:
                continue
            split = keys[2][lo] != keys[3][lo]
            for i, j in near_pairs(encoded[lo:hi]):
                if not split or block[lo + i] != block[lo + j]:
                    rows += [(lo + i, lo + j), (lo + j, lo + i)]
        a, b = [r[0] for r in rows], [r[1] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([word[i] for i in a], pa.string()), pa.array([word[i] for i in b], pa.string()), pa.array(n[b])], ["word", "near", "near_n"]
        )


def near_words(words, rare=RARE, tile=TILE, min_length=MIN_LENGTH):
    """(word, near, near_n), both directions, of words (word, n) of at least min_length letters up to U+00FF."""
    longest = longest_gram(min_length)
    named = stored(words.select(F.xxhash64("word").alias("word_id"), "word", "n"))
    clash = named.groupBy("word_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count()
    if clash:  # two words of one hash; numbers instead
        named = stored(words.select(F.monotonically_increasing_id().alias("word_id"), "word", "n"))
    grams = stored(dictionary(named, longest))
    lists = stored(postings(decompose(named, grams, longest, rare), longest).join(named, "word_id"))
    tiles = in_tiles(lists, ["gram", "time"], uniform("word_id"), tile)
    order = ["gram", "time", "__i", "__j"]
    dealt = tiles.select("word", "n", "__block", *order).repartition(*order).sortWithinPartitions(*order, "__block", "word")
    return dealt.mapInArrow(_verified, "word string, near string, near_n bigint").distinct()


def last_forms(forms):
    """(word, root) for (word, form): every pass doubles the steps taken; a form is more frequent than its word, so there is no cycle."""
    steps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        further = stored(
            steps.join(onward, steps["root"] == onward["__word"], "left")
            .select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved"))
        )
        moved = further.where("moved").limit(1).count()
        steps = further.select("word", "root")
        if not moved:
            return steps


def variants(words, ratio=RATIO, rare=RARE, tile=TILE, min_length=MIN_LENGTH):
    """(word, form, root, n, n_near, form_n) for words (word, n), distinct, of letters up to U+00FF.

    A word's form is its most frequent near word (ties: the first in code-point order) where
    that is at least `ratio` times as frequent; root is where the forms lead to. Words without
    near words are their own root; an empty table gives no rows.
    """
    words = stored(words.select("word", "n"))
    near = near_words(words, rare, tile, min_length)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    linked = stored(near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best))
    known = words.join(linked, "word", "left")
    likely = F.coalesce(-F.col("best.order") >= ratio * F.col("n"), F.lit(False))
    formed = stored(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(likely, F.col("best.near")).alias("form"), F.when(likely, -F.col("best.order")).alias("form_n"),
    ))
    roots = last_forms(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs, min_count=MIN_COUNT):
    """variants() of all words of the documents that occur at least min_count times."""
    return variants(damaged_words(docs).where(F.col("n") >= min_count))
