"""Screening results: JSON text to per-filter outcomes and a fail-closed summary.

A result is parsed in stages (object -> filters -> wrapper -> fields) so that one
malformed filter never hides a match in the one next to it.
"""

from functools import reduce

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import scalars as X

ALL_WRAPPERS = ("inspectResult", "redactResult", "deidentifyResult")
TEXT_WRAPPERS = ("inspectResult",)
_MAP = "map<string,string>"
_INNER_FIELDS = ("executionState", "matchState", "raiFilterTypeResults", "findings", "redactedImage")
_INNER = ", ".join(f"{f} string" for f in _INNER_FIELDS)
_INNER_STRUCT = ", ".join(f"{f}: string" for f in _INNER_FIELDS)
_ENVELOPE = "filterMatchState string, invocationResult string, filterResults string"


def parse_required(names):
    """Comma list to array: trimmed, empties dropped."""
    return F.filter(F.transform(F.split(names, ","), lambda s: F.trim(s)), lambda s: s != "")


def _object(text):
    """The text when it is a JSON object, else null."""
    return F.when(text.startswith("{"), text)


def _field(json, path):
    return F.coalesce(F.get_json_object(json, path), F.lit(""))


def result_object(raw, accept_bare=False):
    """The result inside its envelope; text after the closing brace makes it unreadable, white space does not."""
    whole = F.when(raw.rlike(r"\}[ \t\r\n]*\z"), raw)
    inner = _object(F.get_json_object(whole, "$.sanitizationResult"))
    return F.coalesce(inner, F.when(F.get_json_object(whole, "$").isNotNull(), whole)) if accept_bare else inner


def filter_entries(result, wrappers=ALL_WRAPPERS):
    """Array of (name, inner): first wrapper key, then the nested result if there is one.

    `inner` has the fields of _INNER, objects among them still as JSON text. A repeated
    filter name counts once, with its last value. Each level is parsed once.
    """
    raw = F.map_entries(F.from_json(result, _MAP))
    last = F.filter(
        raw, lambda e, i: ~F.exists(F.slice(raw, i + 2, F.size(raw)), lambda later: later.key == e.key)
    )
    nested = ", ".join(f"{w} string" for w in wrappers)
    fields = lambda p: F.struct(*[p[f].alias(f) for f in _INNER_FIELDS])
    first = F.transform(last, lambda e: F.struct(
        e.key.alias("name"), _object(F.get(F.map_values(F.from_json(e.value, _MAP)), F.lit(0))).alias("wrapper")
    ))
    parsed = F.transform(
        F.filter(first, lambda e: e.wrapper.isNotNull()),
        lambda e: F.struct(e["name"].alias("name"), F.from_json(e.wrapper, f"{_INNER}, {nested}").alias("p")),
    )
    return F.coalesce(F.transform(parsed, lambda e: F.struct(
        e["name"].alias("name"),
        F.coalesce(F.from_json(F.coalesce(*[_object(e.p[w]) for w in wrappers]), _INNER), fields(e.p)).alias("inner"),
    )), F.expr(f"cast(array() as array<struct<name: string, inner: struct<{_INNER_STRUCT}>>>)"))


def subtype_names(name, inner):
    """Matched sub-types as name:type, or the bare name when none is reported."""
    types = F.map_entries(F.from_json(inner.raiFilterTypeResults, _MAP))
    hit = F.transform(
        F.filter(types, lambda t: _field(t.value, "$.matchState") == S.MATCH),
        lambda t: F.concat(name, F.lit(":"), t.key),
    )
    return F.when(F.coalesce(F.size(hit), F.lit(0)) > 0, hit).otherwise(F.array(name))


def finding_names(inner):
    """Distinct info types in first-seen order; a type is a string or an object with a name."""
    items = F.from_json(inner.findings, "array<struct<infoType:string>>")
    names = F.transform(items, lambda f: F.coalesce(F.get_json_object(f.infoType, "$.name"), f.infoType))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def summarize(df, raw, required=S.REQUIRED_FILTERS, prefix="", wrappers=ALL_WRAPPERS,
              accept_bare=False, filter_fault=None, flat=None):
    """Adds verdict, filters, invocation, match_state, complete, findings, redacted_image.

    `allowed` needs NO_MATCH_FOUND, a successful (or unreported) invocation and a
    successful run of every required filter, of which there must be at least one.
    `filter_fault` marks rows where the gateway itself reported a match. `flat` is a
    JSON column with flattened fields, used where the result cannot be read.
    """
    c = lambda name: F.col(f"{prefix}{name}")
    obj, entries, matched = f"__{prefix}result", f"__{prefix}entries", f"__{prefix}matched"
    df = df.withColumn(obj, F.from_json(result_object(F.col(raw), accept_bare), _ENVELOPE))
    df = df.withColumn(entries, filter_entries(F.col(obj).filterResults, wrappers))
    text = lambda value: F.coalesce(value, F.lit(""))
    match_state, invocation = text(F.col(obj).filterMatchState), text(F.col(obj).invocationResult)
    hit = F.filter(F.col(entries), lambda e: text(e.inner.matchState) == S.MATCH)
    ran = F.transform(F.filter(F.col(entries), lambda e: text(e.inner.executionState) == S.RAN), lambda e: e["name"])
    names = F.flatten(F.transform(matched, lambda e: subtype_names(e["name"], e.inner)))
    if flat is not None:
        unread = F.col(obj).isNull()
        wrapped = {k: w + (".inspectResult" if k == "sdp" else "") for k, w in S.RESULT_WRAPPERS.items()}
        get = lambda k, field: _field(F.col(flat), f"$['{wrapped[k]}.{field}']")
        pick = lambda field, value: F.array_compact(
            F.array(*[F.when(get(k, field) == value, F.lit(k)) for k in wrapped])
        )
        match_state = F.when(unread, _field(F.col(flat), "$.filterMatchState")).otherwise(match_state)
        invocation = F.when(unread, _field(F.col(flat), "$.invocationResult")).otherwise(invocation)
        names = F.when(unread, pick("matchState", S.MATCH)).otherwise(names)
        ran = F.when(unread, pick("executionState", S.RAN)).otherwise(ran)
    sdp = F.filter(F.col(matched), lambda e: e["name"] == "sdp")
    required_ok = reduce(
        lambda a, b: a & b, [F.array_contains(F.col(f"__{prefix}ran"), r) for r in required], F.lit(len(required) > 0)
    )
    fault = F.lit(False) if filter_fault is None else F.coalesce(filter_fault, F.lit(False))
    df = df.withColumns({
        matched: hit, f"__{prefix}ran": ran, f"{prefix}match_state": match_state, f"{prefix}invocation": invocation,
    })
    df = df.withColumns({
        f"{prefix}filters": names,
        f"{prefix}complete": required_ok & c("invocation").isin("", "SUCCESS"),
        f"{prefix}findings": F.coalesce(
            F.array_distinct(F.flatten(F.transform(sdp, lambda e: finding_names(e.inner)))), X.empty_strings()
        ),
        f"{prefix}redacted_image": F.nullif(F.get(sdp, F.lit(0)).inner.redactedImage, F.lit("")),
    })
    df = df.withColumn(
        f"{prefix}verdict",
        F.when((F.size(c("filters")) > 0) | (c("match_state") == S.MATCH) | fault, S.BLOCKED)
        .when((c("match_state") == S.NO_MATCH) & c("complete"), S.ALLOWED)
        .otherwise(S.INCOMPLETE),
    ).drop(obj, entries, matched, f"__{prefix}ran")
    return X.computed_once(df, f"{prefix}filters", f"{prefix}complete", f"{prefix}verdict")


def summarize_text(df, raw, required=S.REQUIRED_FILTERS, prefix="", filter_fault=None, flat=None):
    """As summarize, for the text-only pipeline: a bare result is fine, fewer wrappers are read."""
    return summarize(df, raw, required, prefix, TEXT_WRAPPERS, True, filter_fault, flat)


def simple_verdict(raw):
    """Legacy check on two fields; it does not look at which filters ran."""
    state = _field(raw, "$.sanitizationResult.filterMatchState")
    invocation = _field(raw, "$.sanitizationResult.invocationResult")
    return (
        F.when(state == S.MATCH, S.BLOCKED)
        .when((invocation != "SUCCESS") | (state != S.NO_MATCH), S.INCOMPLETE)
        .otherwise(S.ALLOWED)
    )


def explode_filters(df, raw, keep=()):
    """One row per item and reported filter: states and matched names."""
    results = F.get_json_object(result_object(F.col(raw)), "$.filterResults")
    rows = df.select(*keep, F.inline(filter_entries(results)))
    inner = F.col("inner")
    return rows.select(
        *keep,
        F.col("name").alias("filter"),
        F.coalesce(inner.executionState, F.lit("")).alias("execution_state"),
        F.coalesce(inner.matchState, F.lit("")).alias("match_state"),
        F.when(
            inner.matchState == S.MATCH, subtype_names(F.col("name"), F.col("inner"))
        ).alias("names"),
    )


def extract_fields(raw):
    """The six flat fields of a result, null when missing."""
    base = "$.sanitizationResult"
    states = ["rai", "pi_and_jailbreak", "malicious_uris", "sdp"]
    path = lambda k: f"{base}.filterResults.{k}.{S.RESULT_WRAPPERS[k]}" + (".inspectResult" if k == "sdp" else "")
    return [
        F.get_json_object(raw, f"{base}.filterMatchState").alias("match_state"),
        F.get_json_object(raw, f"{base}.invocationResult").alias("invocation"),
        *[F.get_json_object(raw, f"{path(k)}.matchState").alias(f"{k}_state") for k in states],
    ]


def emulate_result(hits, over_limit, skipped=None, redacted_image=None, findings=None):
    """Result JSON for rule hits, in the shape the screening service answers with.

    Input over the limits was not screened: no match, every filter skipped, invocation
    failed. `skipped` names filters that did not run.
    """
    skipped = X.empty_strings() if skipped is None else skipped
    has = lambda name: F.exists(hits, lambda h: X.base_filter(h) == name) & ~over_limit

    def state(name):
        return [
            F.when(over_limit | F.array_contains(skipped, name), S.SKIPPED).otherwise(S.RAN).alias("executionState"),
            F.when(has(name), S.MATCH).otherwise(S.NO_MATCH).alias("matchState"),
        ]

    def subtype(sub):
        hit = F.array_contains(hits, f"rai:{sub}") & ~over_limit
        return F.struct(
            F.when(hit, "HIGH").otherwise("LOW").alias("confidenceLevel"),
            F.when(hit, S.MATCH).otherwise(S.NO_MATCH).alias("matchState"),
        ).alias(sub)

    def wrap(name, inner):
        return F.struct(inner.alias(S.RESULT_WRAPPERS[name])).alias(name)

    rai = F.struct(*state("rai"), F.struct(subtype("dangerous"), subtype("harassment")).alias("raiFilterTypeResults"))
    extra = []
    if findings is not None:
        extra.append(F.transform(findings, lambda t: F.struct(t.alias("infoType"))).alias("findings"))
    if redacted_image is not None:
        extra.append(redacted_image.alias("redactedImage"))
    nested = "redactResult" if extra else "inspectResult"
    results = F.struct(
        wrap("csam", F.struct(*state("csam"))),
        wrap("malicious_uris", F.struct(*state("malicious_uris"))),
        wrap("rai", rai),
        wrap("pi_and_jailbreak", F.struct(*state("pi_and_jailbreak"))),
        wrap("sdp", F.struct(F.struct(*state("sdp"), *extra).alias(nested))),
    )
    any_hit = (F.size(hits) > 0) & ~over_limit
    return F.to_json(F.struct(F.struct(
        F.when(any_hit, S.MATCH).otherwise(S.NO_MATCH).alias("filterMatchState"),
        F.when(over_limit, "FAILURE").otherwise("SUCCESS").alias("invocationResult"),
        results.alias("filterResults"),
    ).alias("sanitizationResult")))
