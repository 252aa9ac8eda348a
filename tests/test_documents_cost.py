"""What reading a document takes, and that the short ways give the same text as the long ones."""

import random

from pyspark.sql import functions as F

from parapet.functions import pdf_reader as R, scalars as X
from tests.conftest import by


class Counted:
    def __init__(self, pattern):
        self.pattern, self.n = pattern, 0

    def match(self, data, at):
        self.n += 1
        return self.pattern.match(data, at)


def test_blanks_are_no_tokens_of_their_own(monkeypatch):
    counted = Counted(R._SYNTAX)
    monkeypatch.setattr(R, "_SYNTAX", counted)
    shown = R._shown(b"BT " + b"<0041> Tj \x00 T*\n" * 1000 + b" ET % end", lambda name: lambda s: s[1:].decode())
    assert shown.split("\n").count("A") == 1000
    assert counted.n <= 3 * 1000 + 4


def test_codes_of_a_map(monkeypatch):
    codes = R._CharMap(b"2 beginbfchar <0001> <0048> <0002> <00690021> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange")
    calls = []
    look = codes.look
    codes.known.look = lambda code: calls.append(code) or look(code)
    monkeypatch.setattr(R, "_CODES", 3)
    assert codes.text(bytes.fromhex("0001000200100011001200FF000100")) == "Hi!abcH"
    assert len(calls) == len(set(calls)) == 6
    narrow = R._CharMap(b"1 beginbfchar <41> <00e9> endbfchar")
    assert narrow.text(b"AAB" * 2) == "éééé"
    both = R._CharMap(b"2 beginbfchar <41> <0061> <0001> <0062> endbfchar")
    assert both.text(b"A\x00\x01A") == "aba"


def test_hex_strings():
    values = [v for v, _ in R._values(b"<4> <4 1 42> <41\n42> <4x1> <> <41\xe942> <</A <41>/B[1 .5 -2.]>>")]
    assert values == [b"@", b"AB", b"AB", b"A", b"", b"AB", {"A": b"A", "B": [1.0, 0.5, -2.0]}]


def test_texts_with_nothing_to_change_equal_the_rest(spark):
    pick = random.Random(5)
    bits = ["a", "é", " ", " ", "\n", "\n", "\t", "\xa0", "\r", " ", "​", "\x07", "﻿", "　", "  ", "word", "\U0001f600"]
    plain = ["a", "é", " ", "\n", "word", "ü"]
    rows = [(i, "".join(pick.choices(bits if i % 2 else plain, k=pick.randrange(9)))) for i in range(600)] + [(-1, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    whole = F.regexp_replace("t", r"\A[\s\p{Z}\x{FEFF}]++|(?<![\s\p{Z}\x{FEFF}])[\s\p{Z}\x{FEFF}]++\z", "")
    squeezed = F.regexp_replace(F.regexp_replace("t", r"[\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n"), r"[ \t\x{A0}]+", " ")
    lines = F.regexp_replace(squeezed, r"(?<![\s\p{Z}])[\s\p{Z}]*\n[\s\p{Z}]*", "\n")
    ends = F.regexp_replace(lines, r"\A[\s\p{Z}]++|(?<![\s\p{Z}])[\s\p{Z}]++\z", "")
    long_way = F.regexp_replace(ends, r"[\p{C}\p{Z}&&[^\n ]]+", "")
    got = by(df.select("i", X.strip(F.col("t")).alias("s"), whole.alias("w"), X.normalize_column("t").alias("n"),
                       X.normalize_lines(F.col("t")).alias("m"), long_way.alias("l")), "i", "s", "w", "n", "m", "l")
    assert all(s == w and n == m == l for s, w, n, m, l in got.values()) and got[-1] == (None,) * 5
