"""Line-first cleaning against a plain version: nulls, odd and long texts, repeats, clashing columns."""

import random
import re
from collections import Counter

from parapet.llm import quality
from tests.llm.test_operators import ODD, prose

SPACES = re.compile("[\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = [w for w in SPACES.split(text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if SPACES.sub("", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def figures(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def test_figures_equal_a_plain_count(make, spread):
    r = random.Random(1)
    phrase = [prose(9, i) for i in range(3)]
    mixed = ["\n".join(r.choice([*phrase, "", "  ", "a b", prose(12, r.randrange(5)), "x | y > z\x0b#"]) for _ in range(r.randrange(30))) for _ in range(60)]
    docs = ODD + [(100 + i, t) for i, t in enumerate(mixed)] + [(200, "la " * 30_000), (201, prose(40_000)), (202, "é" * 500_000), (203, "    x")]
    got = Counter((r.doc_id, *figures(r), r.base_failed) for r in quality.judge(spread(make(docs))).collect())
    want = Counter()
    for d, t in docs:
        f = plain(t)
        want[(d, *f, f[0] < 20 or 100 * f[4] > 30 * f[0])] += 1
    assert got == want


def test_failing_lines_go_and_decide(make):
    body = "One plain sentence stands here, with some words in it."
    other, last = "Another one tells of seven wizards and their moonlight.", "Nobody ever mixed potions under such a pale sky."
    menu, stock, bare, shout = "Home | About | Contact | Help", "All rights reserved.", "no sentence end here", "BUY!! NOW!! CHEAP.!!"
    kept = "\n".join([body, menu, other, stock, bare, "", shout, "Read more »", f"It says “{last}”"])
    lost = "\n".join([body, *[f"n{i} | m{i} | k{i} | p{i} | q{i}" for i in range(9)]])
    rows = {r.doc_id: r for r in quality.judge(make([(1, kept), (2, lost), (3, f'{body} {other} {last}')])).collect()}
    assert rows[1].kept and rows[1].cleaned == "\n".join([body, other, "", f"It says “{last}”"])
    assert (rows[1].n_boilerplate_lines, rows[1].n_navigation_lines, rows[1].n_punctuation_lines) == (1, 2, 2)
    assert not rows[2].kept and not rows[2].base_failed and rows[3].kept


def test_long_prose_with_a_stock_phrase_stays(make):
    line = prose(40).capitalize() + " and the privacy policy of the town."
    assert quality.judge(make([(1, line)])).first().kept


def test_empty_table(make):
    assert quality.judge(make([])).count() == 0
