"""Rules as a table: texts meet only the rules whose required word part they hold.

A pattern's part is the longest run of letters and digits that every match must contain. The
distinct words of all texts are matched with the parts once (by a three-letter key, an
equi-join), so a text's words lead to its candidate rules, and only those patterns are run.
"""

from pyspark.sql import functions as F

from parapet.functions import scalars as X

SCANNED = 200  # rules without a part, each a literal pattern of one scan
KEY = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_QUOTED = r"\A(?:\(\?i\))?\\Q((?:(?!\\E)[\s\S])*)\\E\z"
# In this order: what a match need not contain becomes a blank. Anything that this does not
# understand (alternatives, other flags, comments) leaves the pattern without a part.
_BLANKED = [
    r"\A\(\?i\)",
    r"\\[0-9xucpPkQE](?:\{[^}]*\}|<[^>]*>|[0-9A-Fa-f]{0,4})",  # escapes with an argument
    r"\\[\s\S](?:[?*+]|\{[^}]*\})?",
    r"\[(?:[^\[\]])*\](?:[?*+]|\{[^}]*\})?",
    r"[^()](?:[?*]|\{[^}]*\})",
]
_GROUP = r"\([^()]*\)(?:[?*+]|\{[^}]*\})*"
_NESTING = 4


def low(text):
    return F.translate(text, UPPER, LOWER)


def required_part(pattern):
    """The longest run of at least three ASCII letters and digits, in lower case, in every match of a pattern; null if unknown."""
    rest = pattern
    for blank in _BLANKED:
        rest = F.regexp_replace(rest, blank, " ")
    for _ in range(_NESTING):
        rest = F.regexp_replace(rest, _GROUP, " ")
    known = ~F.contains(pattern, F.lit("|")) & ~rest.rlike(r"[()\[\]\\]") & ~pattern.rlike(r"\(\?[a-z]*[^i:=!<)a-z]|\(\?(?!i\))[a-z]+[:)]|\[[^\]]*(?:\[|&&)")
    quoted = F.regexp_extract(pattern, _QUOTED, 1)
    plain = F.when(quoted != "", quoted).when(known, rest)
    parts = F.regexp_extract_all(low(plain), F.lit("[a-z0-9]{3,}"), F.lit(0))
    best = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("part"))))
    return best["part"]


def words_of(text):
    return F.array_distinct(F.regexp_extract_all(low(text), F.lit(f"[a-z0-9]{{{KEY},}}"), F.lit(0)))


def match_rule_table(df, rules, text="text", keys=("doc_id",)):
    """(keys, rule_id, filter) for each row of `df` and each rule (rule_id, filter, pattern) that its text matches.

    No cross join: candidates come by equal keys, and rules without a required part, of which
    there may be SCANNED, become literal patterns of one scan. `rules` is read twice.
    """
    known = rules.select("rule_id", "filter", "pattern", required_part(F.col("pattern")).alias("part"))
    scanned = known.where("part is null").select("rule_id", "filter", "pattern").limit(SCANNED + 1).collect()
    if len(scanned) > SCANNED:
        raise ValueError(f"more than {SCANNED} rules have no word part that every match must contain, such as {scanned[0].rule_id}")
    texts = df.select(*keys, F.col(text).alias("__text"))
    words = texts.select(*keys, F.explode(words_of(F.col("__text"))).alias("word"))
    # One word per text and part: distinct words meet the parts, not texts.
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w) - KEY + 1), lambda i: F.substr(w, i, F.lit(KEY))))
    vocabulary = words.select("word").distinct().select("word", F.explode(grams(F.col("word"))).alias("key"))
    parts = known.where("part is not null").select("rule_id", "part", F.left("part", F.lit(KEY)).alias("key"))
    held = vocabulary.join(parts, "key").where(F.contains("word", F.col("part"))).select("word", "rule_id").distinct()
    candidates = words.join(held, "word").select(*keys, "rule_id").distinct()
    patterns = known.where("part is not null").select("rule_id", "filter", "pattern")
    met = candidates.join(patterns, "rule_id").join(texts, list(keys))
    found = met.where("regexp(__text, pattern)").select(*keys, "rule_id", "filter")
    if not scanned:
        return found
    kind = f"array<struct<rule_id:{dict(rules.dtypes)['rule_id']},filter:string>>"
    hits = F.array_compact(F.array(*[
        F.when(F.col("__text").rlike(r.pattern), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.filter).alias("filter"))) for r in scanned
    ]))
    return found.unionByName(X.computed_once(texts.select(*keys, hits.cast(kind).alias("hits")), "hits").select(*keys, F.inline("hits")))
