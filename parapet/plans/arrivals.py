"""Queries of what arrives piece by piece: timed parts, findings by position, rules and known ids from tables."""

import tempfile
import uuid

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import spans as P
from parapet.operators import ledger as L
from parapet.operators import rules as R
from parapet.plans.audit import LOG_SQL, MERGED_COLUMNS_SQL, local_and_log, merged_columns, parsed_events
from parapet.plans.common import SEEDS, TURNS_SQL, TYPE_SEEDS, conversations, docs_sql, documents, query, quote, screened_sql
from parapet.sources.readers import new_to_ledger, read_ledger, read_table, spread
from parapet.sources.writers import append_ledger
from parapet.streaming import requests as Q

# --- parts in time ---------------------------------------------------------------------------
# Every turn is a part that arrives as many seconds after its request as its length modulo 40.


@query(f"""
WITH {TURNS_SQL}, s AS {screened_sql('turns', 'conv_id, turn + 1 AS n, length(text) % 40 AS after')},
r AS (SELECT conv_id, max(turn) + 1 AS n_expected FROM turns GROUP BY conv_id),
f AS (
  SELECT conv_id, count(*) AS n_parts, bool_or(verdict = 'blocked') AS bad, bool_and(verdict = 'allowed') AS good,
         string_agg('p' || n || ':' || replace(filters, ',', ',p' || n || ':'), ',' ORDER BY n) FILTER (verdict = 'blocked') AS matched
  FROM s WHERE after <= {S.RESULT_WAIT_SECONDS} GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS request_id, n_expected, coalesce(n_parts, 0) AS n_parts,
       CASE WHEN bad THEN 'blocked' WHEN good AND n_parts >= n_expected THEN 'allowed' ELSE 'incomplete' END AS verdict,
       coalesce(matched, 'none') AS matched, greatest(coalesce(n_parts, 0), n_expected) > {1 + S.MAX_FILES} AS over_limit
FROM r LEFT JOIN f USING (conv_id)
""")
def timed_requests(spark, folder):
    """Requests folded from the parts that came in time; the stream `fold_request_stream` gives the same rows."""
    turns = conversations(spark, folder)
    started = F.timestamp_seconds(F.col("conv_id") + 1_700_000_000)
    announced = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("n_parts"))
    timed = turns.select(
        F.col("conv_id").cast("string").alias("request_id"), started.alias("request_ts"), F.lit(None).cast("bigint").alias("n_parts"),
        (F.col("turn") + 1).alias("n"), (started + F.make_interval(secs=F.length("text") % 40)).alias("part_ts"), "text",
    )
    opened = announced.select(
        F.col("conv_id").cast("string").alias("request_id"), started.alias("request_ts"), "n_parts", F.lit(None).cast("bigint").alias("n"),
        started.alias("part_ts"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("array<string>").alias("filters"),
    )
    return Q.fold_requests(Q.screened_parts(timed).unionByName(opened))


# --- findings by position ----------------------------------------------------------------------

_SEEDS = [*SEEDS, *TYPE_SEEDS]
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, text, {quote(name)} AS info_type, regexp_extract_all(text, {quote(p)}) AS ms, string_split_regex(text, {quote(p)}) AS ps FROM docs"
    for name, p in S.INFO_TYPES
)
_JOINED = f"""
{docs_sql(_SEEDS)}, found AS ({_FOUND}),
placed AS (
  SELECT doc_id, info_type, length(ms[i]) AS size,
         CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found)),
swept AS (
  SELECT *, start + size AS stop, coalesce(max(start + size) OVER (
           PARTITION BY doc_id ORDER BY start, size DESC, info_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= start AS opens FROM placed),
grouped AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, size DESC, info_type) AS g FROM swept),
joined AS (
  SELECT doc_id, min(start) AS start, max(stop) AS stop, first(info_type ORDER BY size DESC, start, info_type) AS info_type, count(*) AS n
  FROM grouped GROUP BY doc_id, g)"""


def _spans(spark, folder):
    docs = documents(spark, folder, _SEEDS, columns=("text",))
    return docs.select("doc_id", F.inline(P.join_overlaps(P.finding_spans(F.col("text")))))


@query(f"WITH {_JOINED} SELECT doc_id, start, stop, info_type, n FROM joined")
def finding_spans(spark, folder):
    """Where the findings of all documents are; overlapping ones are one span named after the longest."""
    long = lambda c, name: F.col(c).cast("bigint").alias(name)
    return _spans(spark, folder).select("doc_id", long("start", "start"), long("end", "stop"), "info_type", long("n", "n"))


@query(f"""
WITH {_JOINED}, pieces AS (
  SELECT j.doc_id, start, substr(text, 1 + coalesce(lag(stop) OVER w, 0), start - coalesce(lag(stop) OVER w, 0)) || '[' || info_type || ']' AS piece, stop
  FROM joined j JOIN docs USING (doc_id) WINDOW w AS (PARTITION BY j.doc_id ORDER BY start))
SELECT d.doc_id, coalesce(string_agg(piece, '' ORDER BY start), '') || substr(any_value(d.text), 1 + coalesce(max(stop), 0)) AS redacted
FROM docs d LEFT JOIN pieces p USING (doc_id) GROUP BY d.doc_id
""")
def redact_spans(spark, folder):
    """All documents with their findings cut once, by position."""
    docs = documents(spark, folder, _SEEDS, columns=("text",))
    return docs.select("doc_id", P.redact_spans(F.col("text")).alias("redacted"))


# --- rules from a table --------------------------------------------------------------------------


@query(r"""
WITH rules AS (
  SELECT item_id, '(?i)' || array_to_string(regexp_extract_all(text, '[A-Za-z]{3,}')[3:5], '[^A-Za-z]+(?:[A-Za-z]{1,2}[^A-Za-z]+)*') AS pattern FROM benchmark)
SELECT DISTINCT doc_id, item_id AS rule_id, 'benchmark' AS filter FROM documents JOIN rules ON regexp_matches(text, pattern)
""")
def benchmark_rules(spark, folder):
    """Documents that hold three words of a benchmark item in their order; the rules are rows made from `benchmark`."""
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), 3, 3)
    pattern = F.concat(F.lit("(?i)"), F.array_join(words, "[^A-Za-z]+(?:[A-Za-z]{1,2}[^A-Za-z]+)*"))
    rules = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("rule_id"), F.lit("benchmark").alias("filter"), pattern.alias("pattern"))
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return R.match_rule_table(docs, rules)


# --- a stored ledger ------------------------------------------------------------------------------


def work_folder(spark):
    """A new folder below the cluster's shared one; a temporary one only where none is named, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="parapet-")
    return f"{shared.rstrip('/')}/parapet-ledger/{uuid.uuid4().hex}"


@query(f"WITH {LOG_SQL} SELECT {MERGED_COLUMNS_SQL} FROM (SELECT * FROM local UNION ALL SELECT * FROM fresh)")
def ledger_merge(spark, folder):
    """The ledger stored as a snapshot, the log merged into it by its key buckets, and the stored result read.

    The log is parsed once and stored: the ledger and the merge read the rows.
    """
    path = work_folder(spark)
    parsed_events(spark, folder).write.parquet(f"{path}/_log")
    local, log = local_and_log(spark.read.parquet(f"{path}/_log"))
    append_ledger(local, path, "local")
    append_ledger(new_to_ledger(log, path), path, "log-0")
    return merged_columns(read_ledger(spark, path))
