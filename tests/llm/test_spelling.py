"""Spelling variants against brute force: hot grams, ties, chains, long words, odd texts."""

import random
import re
import zlib
from collections import Counter

import pytest

from parapet.llm import spelling
from tests.llm.test_operators import ODD, prose


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def plain_counts(docs, least):
    counts = Counter()
    for doc_id, text, *_ in docs:
        table = str.maketrans(spelling.UPPER, spelling.LOWER)
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(table)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            counts[word] += len(word) >= 6
    return {w: n for w, n in counts.items() if n >= least}


def random_counts(seed, n, letters="abc", sizes=(6, 9)):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(*sizes))): r.choice([5, 6, 30, 31, 200, 2000]) for _ in range(n)}


@pytest.mark.parametrize("seed, rare, tile", [(1, 2, 8), (2, 16, 512), (3, 10**6, 32)])
def test_dense_words(spark, spread, seed, rare, tile):
    """Few letters, so that most words are near others and most grams are hot."""
    counts = random_counts(seed, 500) | random_counts(seed, 60, "éß÷z", (6, 7))
    words = spread(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    rows = spelling.variants(words, rare=rare, tile=tile).collect()
    assert len(rows) == len(counts) and {tuple(r) for r in rows} == plain(counts)


def test_ends_repeats_and_chains(spark):
    counts = {"ananas": 5, "ananasa": 30, "anananas": 4000, "anananasa": 200, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "baaaaaaa": 125,
              "xxxxxx" * 40: 7, "xxxxxx" * 40 + "x": 50, "y" + "xxxxxx" * 40 + "x": 400, "abcdef": 9, "bcdefg": 9}
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()
    assert {tuple(r) for r in rows} == plain(counts)
    assert next(r for r in rows if r.word == "aaaaaa").root == "aaaaaaaa"


def test_every_edit_leaves_a_shared_gram(spark):
    """The bound, for all edits of words whose grams were made as long as they may be."""
    counts = {w: 10 for w in random_counts(7, 80, "ab", (6, 8))}
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"), rare=1).collect()
    assert {tuple(r) for r in rows} == plain(counts)


def test_documents(make, spread):
    r = random.Random(4)
    pool = ["Wizard", "wizard", "wizards", "wizzard", "PÄCKCHEN", "pÄckchen", "päckchen", "straße", "naïveté", "naïvetés", "a×b÷cdef", "tiny"]
    docs = ODD + [(i, " ".join(r.choice(pool) + r.choice(["", "", "1", "-", "."]) for _ in range(200))) for i in range(200, 320)]
    docs += [(400 + i, "q" * 20_000) for i in range(6)] + [(500, prose(3000).replace("0", "") + "\x00 ퟿")]
    counts = plain_counts(docs, 1)
    assert counts == {r.word: r.n for r in spelling.damaged_words(spread(make(docs))).collect()}
    rows = spelling.group_variants(spread(make(docs))).collect()
    assert {tuple(r) for r in rows} == plain(plain_counts(docs, 5))


def test_empty_table(make):
    assert spelling.group_variants(make([])).count() == 0
