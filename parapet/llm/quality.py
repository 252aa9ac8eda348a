"""Quality rules, line first: lines that fail go, and so do documents that lose too much. DataFrame functions only.

Each document is worked on in its own row, so nothing is shuffled and no hot source or
group of copies matters.
"""

import functools
import operator

from pyspark.sql import functions as F

from parapet.llm.common import WORD, let

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
SEPARATORS = "[|»›•·>]"
TERMINALS = ".!?…。！？"
CLOSERS = "\"'”’»)]"
SHOUT = "[!?][!?]"
MENU = (
    r"(?i)^[ \t]*(home|next|previous|back to top|skip to (main )?content|read more|click here|menu|search|log ?in"
    r"|sign (in|up)|share this|page [0-9]+( of [0-9]+)?)[ \t.!:»>]*$"
)
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "cookie", "privacy policy", "terms of use",
    "terms of service", "javascript", "copyright", "©", "lorem ipsum", "subscribe to",
)
BOILERPLATE_WORDS = 30  # a longer line is prose that happens to use such a phrase
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words
WINDOW = 8
MAX_LOST = 50  # percent of the words
RULES = ("boilerplate", "navigation", "punctuation")


def count_of(text, pattern):
    return F.regexp_count(text, F.lit(pattern))


def stock_phrase(line):
    return let(F.lower(line), lambda x: functools.reduce(operator.or_, [F.contains(x, F.lit(p)) for p in BOILERPLATE]))


def text_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_fault(line, words):
    """The first rule of RULES that a line fails, null where it passes; a line without words passes.

    boilerplate: a stock phrase in a line of up to BOILERPLATE_WORDS words.
    navigation: a menu entry on its own, or at least two separators and one for every four words.
    punctuation: no sentence end at the line's end, or a symbol for every third word, or
    doubled exclamation or question marks for every third word.
    """
    separators, symbols = count_of(line, SEPARATORS), count_of(line, SYMBOLS)
    end = F.right(F.rtrim(line, F.lit(SPACE + CLOSERS)), F.lit(1))
    unended = (end == "") | ~F.contains(F.lit(TERMINALS), end)
    shouts = count_of(line, SHOUT)
    return (
        F.when(words == 0, F.lit(None).cast("string"))
        .when((words <= BOILERPLATE_WORDS) & stock_phrase(line), "boilerplate")
        .when(((separators >= 2) & (4 * separators >= words)) | line.rlike(MENU), "navigation")
        .when(unended | (3 * symbols >= words) | (3 * shouts >= words), "punctuation")
    )


def judged_lines(text):
    """array<struct<line, words, fault>> of a text."""
    return F.transform(text_lines(text), lambda line: let(count_of(line, WORD), lambda n: F.struct(
        line.alias("line"), n.alias("words"), line_fault(line, n).alias("fault")
    )))


def repeated_words(words):
    """How many words lie in a window of WINDOW words that occurs more than once; windows are compared by 64-bit hashes.

    Covered words are counted from the sorted starts of repeated windows: each adds the
    distance to the next one, at most WINDOW. So the work is that of a sort.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    ))

    def covered(w):
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        starts = let(placed, lambda p: F.array_sort(F.transform(
            F.filter(p, lambda e, k: (F.get(p, k - 1)["x"] == e["x"]) | (F.get(p, k + 1)["x"] == e["x"])), lambda e: e["i"]
        )))
        gaps = let(starts, lambda s: F.transform(s, lambda at, k: F.least(F.coalesce(F.get(s, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    return F.when(F.size(words) <= WINDOW, 0).otherwise(
        let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    )


def statistics(text):
    """Struct of the base figures of a whole text; a null text has no words."""
    whole = F.coalesce(text, F.lit(""))
    bare = F.btrim(whole, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))
    filled = F.filter(text_lines(text), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        (F.length(whole) - count_of(whole, r"[\x20\x09-\x0D]")).cast("bigint").alias("word_chars"),
        count_of(whole, SYMBOLS).cast("bigint").alias("n_symbols"),
        let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(w).cast("bigint").alias("n_repeat_words"),
    ))


def judge(docs):
    """(doc_id, figures, line counts, base_failed, kept, cleaned) for each row of (doc_id, text).

    Null texts have no words and fail; an empty table gives no rows; repeated rows and ties
    are judged row by row; other columns do not matter. A document is rejected when its base figures fail or when the
    lines that fail hold MAX_LOST percent of its words or more.
    """
    failing = lambda rule: F.size(F.filter("lines", lambda x: x["fault"] == rule)).cast("bigint")
    n_lines = [failing(rule).alias(f"n_{rule}_lines") for rule in RULES]
    lost = F.aggregate("lines", F.lit(0), lambda a, x: a + F.when(x["fault"].isNotNull(), x["words"]).otherwise(0))
    cleaned = F.array_join(F.transform(F.filter("lines", lambda x: x["fault"].isNull()), lambda x: x["line"]), "\n")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    # A generator keeps both structs as columns; projections would repeat them for each field.
    both = F.inline(F.array(F.struct(statistics(F.col("text")).alias("base"), judged_lines(F.col("text")).alias("lines"))))
    judged = docs.select("doc_id", both).select("doc_id", "base.*", *n_lines, lost.cast("bigint").alias("n_lost_words"), cleaned.alias("cleaned"))
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") < MAX_LOST * F.col("n_words"))
    )
