"""Comparisons: one mode against the other, verdicts against expectations and labels."""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import scalars as X
from parapet.operators import verdicts as V


def pair_modes(df, keys, values=("verdict", "filters", "latency_ms")):
    """One row per item with native_* and callout_* columns: a single aggregation, no self-join."""
    side = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c))).alias(f"{mode}_{c}")
    return df.groupBy(*keys).agg(*[side(m, c) for m in ("native", "callout") for c in values])


def base_names(filters):
    """Sorted base names; repeats stay, as two matches of one filter are two."""
    return F.array_sort(F.transform(filters, X.base_filter))


def compare_modes(df, keys):
    """Verdict of each mode, whether they agree, and what differs."""
    native, callout = F.col("native_verdict"), F.col("callout_verdict")
    same = F.coalesce(native == callout, F.lit(False))
    differ = base_names(F.col("native_filters")) != base_names(F.col("callout_filters"))
    return pair_modes(df, keys).select(
        *keys,
        "native_verdict",
        "callout_verdict",
        same.alias("same_verdict"),
        (same & (native == S.BLOCKED) & F.coalesce(differ, F.lit(False))).alias("filters_differ"),
        V.combine_modes(native, callout).alias("combined"),
        X.latency_delta(F.col("native_latency_ms"), F.col("callout_latency_ms")).alias("latency_delta"),
    )


def scenario_check(df, scenario="scenario_id", scenarios=S.SCENARIOS):
    """Per scenario: how many results have the expected verdict and, where blocked, filter.

    Filters are compared by base name. The grouping keys are the few scenario ids, so
    partial aggregation leaves a handful of rows per task.
    """
    sid = F.col(scenario)
    expect = X.lookup({s[0]: s[1] for s in scenarios}, sid)
    wanted = X.lookup({s[0]: s[2] for s in scenarios if s[2]}, sid)
    verdict_ok = F.col("verdict") == expect
    hit = F.array_contains(F.transform("filters", X.base_filter), X.base_filter(wanted))
    filter_ok = wanted.isNull() | (F.col("verdict") != S.BLOCKED) | hit
    return df.where(expect.isNotNull()).groupBy(scenario).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(verdict_ok).alias("n_verdict_ok"),
        F.count_if(filter_ok).alias("n_filter_ok"),
        F.bool_and(verdict_ok & filter_ok).alias("passed"),
    )


def confusion(df, pairs):
    """Confusion counts of several (name, actual, predicted) pairs in one pass, one row each."""
    count = lambda a, p, x, y: F.count_if((a == F.lit(x)) & (p == F.lit(y)))
    aggs = []
    for name, actual, predicted in pairs:
        aggs += [
            count(actual, predicted, True, True).alias(f"{name}_tp"),
            count(actual, predicted, False, True).alias(f"{name}_fp"),
            count(actual, predicted, True, False).alias(f"{name}_fn"),
            count(actual, predicted, False, False).alias(f"{name}_tn"),
        ]
    rows = F.array(*[
        F.struct(F.lit(name).alias("label"), *[F.col(f"{name}_{k}").alias(k) for k in ("tp", "fp", "fn", "tn")])
        for name, _, _ in pairs
    ])
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 4)
    return df.agg(*aggs).select(F.inline(rows)).select(
        "*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall")
    )


def hits_rollup(df, group="lang", filters="filters"):
    """Requests and hits by group and filter, with subtotals."""
    rows = X.computed_once(df.select(group, filters), filters).select(group, F.explode(filters).alias("filter"))
    return rows.rollup(group, "filter").agg(
        F.count(F.lit(1)).alias("n_hits"), F.grouping_id().cast("bigint").alias("level")
    )


def count_table(df, filter_col, *by):
    """Pass and fail counters with the all-ok flag."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(filter_col)).alias("n_pass"),
        F.count_if(~F.col(filter_col)).alias("n_fail"),
        F.bool_and(filter_col).alias("all_ok"),
    )


def verdict_triplet_ok(outcome, expected):
    """Whether an outcome struct equals the expected (outcome, prompt, answer) verdicts."""
    return (
        (outcome.outcome == expected[0]) & (outcome.prompt_verdict == expected[1]) & (outcome.answer_verdict == expected[2])
    )


def match_rules(df, rules, text="text", keep=()):
    """(item, rule) rows for a list of rules (rule_order, filter, pattern); no rules, no rows.

    Rules are configuration: each pattern becomes a literal, compiled once, of one scan.
    """
    kind = "array<struct<rule_order:bigint,filter:string>>"
    hit = lambda order, name, pattern: F.when(
        F.col(text).rlike(pattern), F.struct(F.lit(order).cast("bigint").alias("rule_order"), F.lit(name).alias("filter"))
    )
    hits = F.array_compact(F.array(*[hit(*rule) for rule in sorted(rules)])) if rules else F.array()
    return df.select(*keep, F.inline(hits.cast(kind)))
