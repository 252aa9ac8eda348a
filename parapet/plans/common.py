"""Shared inputs of the registered queries, and the same inputs as SQL text."""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.sources.readers import read_table, spread

REGISTRY = {}


def query(sql=None):
    """Register a function (spark, folder) -> DataFrame under its name, with its SQL if it has one."""

    def add(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return add


# The five scenarios ride along with the tables, which hold no injection and no bad link;
# two more rows hold the info types that the tables lack.
SEEDS = [(-1 - i, sid, prompt) for i, (sid, _, _, prompt) in enumerate(S.SCENARIOS)]
TYPE_SEEDS = [
    (-6, "custom", "My number is 078-05-1120, please keep it."),
    (-7, "custom", "Pay to GB82WEST12345698765432 by Friday."),
]


# Answers that a filter must catch, each after the clean scenario's prompt, and one that is fine.
ANSWER_SEEDS = [
    (-11, "See https://cdn.malware-mirror.example/x for the tool."),
    (-12, "Only a worthless idiot would ask that."),
    (-13, "The card is 4111 1111 1111 1111."),
    (-14, "A gateway checks requests and answers."),
    (-15, "Word by word. " * 700),
]


def seeds(spark, rows=SEEDS):
    structs = [
        F.struct(F.lit(i).cast("bigint").alias("doc_id"), F.lit(s).alias("scenario_id"), F.lit(t).alias("text"))
        for i, s, t in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def documents(spark, folder, rows=SEEDS, columns=("text", "lang", "source", "n_chars")):
    """All documents plus the seed rows."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", *columns), "doc_id")
    extra = {"lang": F.lit("en"), "source": F.lit("seed"), "n_chars": F.length("text").cast("bigint"), "text": F.col("text")}
    base = seeds(spark, rows).select("doc_id", "scenario_id", *[extra[c].alias(c) for c in columns])
    return docs.withColumn("scenario_id", F.lit("custom")).select(base.columns).unionByName(base)


def conversations(spark, folder):
    """All turns plus one single-turn conversation per scenario."""
    turns = spread(read_table(spark, folder, "conversations"), "conv_id", "turn").withColumn("scenario_id", F.lit(None).cast("string"))
    base = seeds(spark).select(
        F.col("doc_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"),
        "text", "scenario_id",
    )
    rows = [
        F.struct(F.lit(i).cast("bigint").alias("conv_id"), F.lit(t).cast("bigint").alias("turn"), F.lit(role).alias("role"),
                 F.lit(text).alias("text"), F.lit(None).cast("string").alias("scenario_id"))
        for i, answer in ANSWER_SEEDS
        for t, role, text in ((0, "user", S.SCENARIOS[0][3]), (1, "assistant", answer))
    ]
    return turns.unionByName(base).unionByName(spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows))))


def or_minus_one(name):
    """A number for a report: unknown is -1, so that no tool turns the column into floats."""
    return F.coalesce(F.col(name), F.lit(-1)).alias(name.split(".")[-1])


# --- the same as SQL -----------------------------------------------------------


def quote(text):
    return "'" + text.replace("'", "''") + "'"


def _values(rows):
    return ", ".join(f"({i}, {quote(s)}, {quote(t)})" for i, s, t in rows)


def docs_sql(rows=SEEDS):
    return f"""
    seeds(doc_id, scenario_id, text) AS (VALUES {_values(rows)}),
    docs AS (
      SELECT doc_id, 'custom' AS scenario_id, text, lang, source, n_chars FROM documents
      UNION ALL
      SELECT doc_id, scenario_id, text, 'en', 'seed', length(text) FROM seeds
    )"""


TURNS_SQL = f"""
    seeds(doc_id, scenario_id, text) AS (VALUES {_values(SEEDS)}),
    turns AS (
      SELECT conv_id, turn, role, text, CAST(NULL AS VARCHAR) AS scenario_id FROM conversations
      UNION ALL
      SELECT doc_id, 0, 'user', text, scenario_id FROM seeds
      UNION ALL
      VALUES {", ".join(f"({i}, 0, 'user', {quote(S.SCENARIOS[0][3])}, NULL), ({i}, 1, 'assistant', {quote(t)}, NULL)" for i, t in ANSWER_SEEDS)}
    )"""


def case_hits(text, rules):
    return ", ".join(f"CASE WHEN regexp_matches({text}, {quote(p)}) THEN {quote(name)} END" for name, p in rules)


def filters_sql(text, rules=S.PROMPT_RULES):
    return f"coalesce(nullif(concat_ws(',', {case_hits(text, rules)}), ''), 'none')"


def n_hits_sql(text, rules=S.PROMPT_RULES):
    return " + ".join(f"CAST(regexp_matches({text}, {quote(p)}) AS BIGINT)" for _, p in rules)


def screened_sql(source, columns, text="text", rules=S.PROMPT_RULES, limit=S.MAX_TEXT_CHARS):
    """Sub-query with filters, n_hits and verdict beside the given columns."""
    return f"""(
      SELECT *, CASE WHEN n_hits > 0 THEN 'blocked' WHEN n_text > {limit} THEN 'incomplete' ELSE 'allowed' END AS verdict
      FROM (SELECT {columns}, length({text}) AS n_text, {filters_sql(text, rules)} AS filters,
                   {n_hits_sql(text, rules)} AS n_hits FROM {source}))"""


def replace_all_sql(text, steps):
    for pattern, to in steps:
        text = f"regexp_replace({text}, {quote(pattern)}, {to}, 'g')"
    return text


def normalize_sql(text):
    text = replace_all_sql(text, [
        (r"[\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", "chr(10)"),
        (r"[ \t\x{A0}]+", "' '"),
        (r"[\s\p{Z}]*\n[\s\p{Z}]*", "chr(10)"),
        (r"^[\s\p{Z}]+", "''"),
        (r"[\s\p{Z}]+$", "''"),
    ])
    return replace_all_sql(text, [(r"[\x00-\x09\x0B-\x1F\x7F-\x{9F}\p{Cf}\p{Co}\p{Zl}\p{Zp}]", "''")])
