"""Verdicts of parts, answers and requests, and the records that report them."""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import scalars as X

_RANK = {S.ALLOWED: 1, S.INCOMPLETE: 2, S.BLOCKED: 3}


def verdict_rank(verdict):
    """1 allowed, 2 incomplete or anything else, 3 blocked."""
    return F.coalesce(X.lookup(_RANK, verdict), F.lit(_RANK[S.INCOMPLETE]))


def _from_rank(rank):
    return F.when(rank == 3, S.BLOCKED).when(rank == 1, S.ALLOWED).otherwise(S.INCOMPLETE)


def fold_parts(df, keys, n="n", verdict="verdict", filters="filters", max_parts=1 + S.MAX_FILES):
    """Request verdict from its parts: blocked > incomplete > allowed; no parts is incomplete.

    `matched` lists p<n>:<filter> of blocked parts in part order, however many there are.
    Rows without a part number keep a request in the result without adding a part.
    `over_limit` says apart from that whether it has more than max_parts parts. Only
    blocked parts' names are gathered, partly before the shuffle.
    """
    n_col, is_part = F.col(n), F.col(n).isNotNull()
    blocked = is_part & (F.col(verdict) == S.BLOCKED) & (F.size(filters) > 0)
    label = F.array_join(
        F.transform(filters, lambda f: F.concat(F.lit("p"), n_col.cast("string"), F.lit(":"), f)), ","
    )
    folded = df.groupBy(*keys).agg(
        F.max(F.when(is_part, verdict_rank(F.col(verdict)))).alias("__rank"),
        F.count(n).alias("n_parts"),
        F.max(n_col).alias("__max_n"),
        F.collect_list(F.when(blocked, F.struct(n_col.alias("n"), label.alias("label")))).alias("__labels"),
    )
    joined = F.array_join(F.transform(F.sort_array("__labels"), lambda x: x.label), ",")
    return folded.select(
        *keys,
        "n_parts",
        _from_rank(F.col("__rank")).alias("verdict"),
        F.when(joined == "", "none").otherwise(joined).alias("matched"),
        ((F.col("n_parts") > max_parts) | F.coalesce(F.col("__max_n") > max_parts, F.lit(False))).alias("over_limit"),
    )


def request_verdict(verdict, over_limit):
    """A request of too many parts is an error, but a blocked one stays blocked."""
    return F.when(over_limit & (verdict != S.BLOCKED), S.ERROR).otherwise(verdict)


def worst_verdict(verdict):
    """Aggregate of verdicts: blocked > incomplete > allowed, null for none."""
    rank = F.max(F.when(verdict.isNotNull(), verdict_rank(verdict)))
    return F.when(rank.isNotNull(), _from_rank(rank))


def fold_array(parts):
    """As fold_parts for parts held in one row: array<struct<n, verdict, filters>>."""
    any_is = lambda v: F.exists(parts, lambda p: p.verdict == v)
    verdict = (
        F.when(any_is(S.BLOCKED), S.BLOCKED)
        .when((F.size(parts) == 0) | F.exists(parts, lambda p: ~p.verdict.isin(S.ALLOWED, S.BLOCKED)), S.INCOMPLETE)
        .otherwise(S.ALLOWED)
    )
    labels = F.flatten(F.transform(
        F.filter(parts, lambda p: p.verdict == S.BLOCKED),
        lambda p: F.transform(p.filters, lambda f: F.concat(F.lit("p"), p.n.cast("string"), F.lit(":"), f)),
    ))
    matched = F.when(F.size(labels) > 0, F.array_join(labels, ",")).otherwise("none")
    return F.struct(verdict.alias("verdict"), matched.alias("matched"))


def verdict_for_requests(requests, folded, keys):
    """Verdict of every request; one whose screening never reported is incomplete."""
    return requests.join(folded, keys, "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(S.INCOMPLETE))
    ).withColumn("matched", F.coalesce("matched", F.lit("none")))


def native_prompt_verdict(text_verdict, n_files, flow):
    """Text-only mode: attachments, or an image answer, make a clean prompt unsupported."""
    unscreened = (n_files > 0) | (flow == "image")
    return F.when((text_verdict == S.ALLOWED) & unscreened, S.UNSUPPORTED).otherwise(text_verdict)


def native_part_records(verdict, filters, kinds):
    """Part rows of text-only mode: the screened prompt, then each attachment as unsupported.

    An attachment is never forwarded, and with one neither is the prompt.
    """
    row = lambda n, kind, v, names, sent: F.struct(
        n.cast("bigint").alias("n"), kind.alias("kind"), v.alias("verdict"), names.alias("filters"), sent.alias("forwarded")
    )
    prompt = row(F.lit(1), F.lit("text"), verdict, filters, (verdict == S.ALLOWED) & (F.size(kinds) == 0))
    files = F.transform(kinds, lambda k, i: row(i + 2, k, F.lit(S.UNSUPPORTED), X.empty_strings(), F.lit(False)))
    return F.concat(F.array(prompt), files)


def unsupported_reason(text_verdict, n_files, flow):
    plural = F.when(n_files > 1, "s").otherwise("")
    files = F.concat(
        F.lit("The native check screens text only: "), n_files.cast("string"), F.lit(" attachment"), plural,
        F.lit(" could not be screened, so the request was rejected (fail closed)."),
    )
    image = F.lit("The native check cannot screen a generated image, so the request was not sent (fail closed).")
    return F.when(
        text_verdict == S.ALLOWED, F.when(n_files > 0, files).when(flow == "image", image)
    )


def native_answer_verdict(text_verdict):
    return F.coalesce(text_verdict, F.lit(S.ALLOWED))


def image_state(image_verdict, image_filters, has_redacted, complete, action):
    """none, clean, redacted, incomplete or blocked.

    Only a match of sensitive data alone can be redacted, only where a redacted image
    came back, and only when every required filter ran.
    """
    only_sdp = (F.size(image_filters) > 0) & F.forall(image_filters, lambda f: f == "sdp")
    redactable = F.coalesce((action == "redact") & only_sdp & has_redacted, F.lit(False))
    return (
        F.when(image_verdict.isNull(), "none")
        .when(image_verdict != S.BLOCKED, "clean")
        .when(redactable & complete, "redacted")
        .when(redactable, "incomplete")
        .otherwise("blocked")
    )


def answer_verdict(shape_ok, text_verdict, image_verdict, state):
    """Blocked beats incomplete beats redacted beats allowed; null verdicts mean no such item."""
    is_ = lambda v, x: F.coalesce(v == x, F.lit(False))
    return (
        F.when(is_(text_verdict, S.BLOCKED) | (state == "blocked"), S.BLOCKED)
        .when(
            ~shape_ok | is_(text_verdict, S.INCOMPLETE) | is_(image_verdict, S.INCOMPLETE) | (state == "incomplete"),
            S.INCOMPLETE,
        )
        .when(state == "redacted", S.REDACTED)
        .otherwise(S.ALLOWED)
    )


def answer_record(verdict, text, image, state, action):
    """Names-only record of an answer; text and image are summary structs or null."""
    return F.struct(
        verdict.alias("verdict"),
        F.when(text.isNotNull(), F.struct(text.verdict.alias("verdict"), text.filters.alias("filters"))).alias("text"),
        F.when(image.isNotNull(), F.struct(
            image.verdict.alias("verdict"), state.alias("state"), action.alias("action"),
            image.filters.alias("filters"), image.findings.alias("findings"),
        )).alias("image"),
    )


def answer_matched(text_filters, image_filters):
    label = lambda prefix, names: F.transform(
        F.coalesce(names, X.empty_strings()), lambda f: F.concat(F.lit(prefix), f)
    )
    both = F.concat(label("text:", text_filters), label("image:", image_filters))
    return F.when(F.size(both) > 0, F.array_join(both, ",")).otherwise("none")


# --- status codes and ledger verdicts ---------------------------------------------


def status_verdict(status, error_code=None):
    """Verdict a caller sees for an HTTP status; a rejected request shape is an error."""
    verdict = (
        F.when(status.between(200, 299), S.ALLOWED).when(status.isin(S.BLOCK_STATUSES), S.BLOCKED).otherwise(S.ERROR)
    )
    if error_code is None:
        return verdict
    return F.when(F.coalesce(error_code == "INVALID_ARGUMENT", F.lit(False)), S.ERROR).otherwise(verdict)


def multipart_status_verdict(status, reported, error_code):
    """As status_verdict for the multi-part pipeline, which reports its own verdict on success."""
    return (
        F.when(status == 200, F.when(reported.isin(S.ALLOWED, S.REDACTED), reported).otherwise(S.ALLOWED))
        .when(F.coalesce(error_code == "INVALID_ARGUMENT", F.lit(False)), S.ERROR)
        .when(status == 400, S.BLOCKED)
        .when(status == 503, S.INCOMPLETE)
        .otherwise(S.ERROR)
    )


def ledger_verdict(verdict):
    return F.when(verdict.isin(S.ALLOWED, S.REDACTED), S.ALLOWED).when(verdict == S.BLOCKED, S.BLOCKED).otherwise(S.ERROR)


def strict_status_verdict(status, error_code):
    """A 400 is blocked only when the error says screening blocked it."""
    blocked = (status == 400) & F.coalesce(error_code == S.OUTCOME_CODES[S.BLOCKED][1], F.lit(False))
    return F.when(status.between(200, 299), S.ALLOWED).when(blocked, S.BLOCKED).otherwise(S.ERROR)


def matched_states(states):
    """Filters of a map<filter, match state> that matched."""
    return F.map_keys(F.map_filter(states, lambda _, state: state == S.MATCH))


def outcome(prompt_verdict, answer_verdict_):
    """Outcome, stage and both stage verdicts. The answer is `none` where it was never reached."""
    passed = prompt_verdict == S.ALLOWED
    answer = F.when(passed, F.coalesce(answer_verdict_, F.lit(S.INCOMPLETE))).otherwise("none")
    return F.struct(
        F.when(passed, answer).otherwise(prompt_verdict).alias("outcome"),
        F.when(passed, "response").otherwise("prompt").alias("stage"),
        prompt_verdict.alias("prompt_verdict"),
        answer.alias("answer_verdict"),
    )


def outcome_status(verdict, rejected=None):
    """HTTP status and code of an outcome."""
    rejected = F.lit(False) if rejected is None else rejected
    statuses = {v: status for v, (status, _) in S.OUTCOME_CODES.items()}
    codes = {v: code for v, (_, code) in S.OUTCOME_CODES.items()}
    key = F.when(rejected, S.ERROR).otherwise(verdict)
    ok = key.isin(S.ALLOWED, S.REDACTED)
    return F.struct(
        F.when(ok, 200).otherwise(F.coalesce(X.lookup(statuses, key), F.lit(502))).alias("http_status"),
        F.when(ok, "OK").otherwise(F.coalesce(X.lookup(codes, key), F.lit("UNREACHABLE"))).alias("code"),
    )


def error_record(status, code, stage, message, mode, matched, latency_ms, request_id):
    """JSON error body: names, verdicts and timings, never content."""
    return F.to_json(F.struct(F.struct(
        status.alias("code"), code.alias("status"), stage.alias("stage"), message.alias("message"),
        F.struct(mode.alias("mode"), matched.alias("matched"), latency_ms.alias("latencyMs")).alias("screening"),
        request_id.alias("requestId"),
    ).alias("error")))


def explain(verdict, filters, status, error_code, how="screening"):
    """One line on why a request ended as it did; the first case that fits."""
    names = F.array_join(F.transform(filters, X.filter_label), ", ")
    return (
        F.when(verdict == S.ALLOWED, f"Clean: {how} found nothing.")
        .when((verdict == S.BLOCKED) & (F.size(filters) > 0), F.concat(F.lit("Blocked: "), names))
        .when(F.coalesce(error_code == "INVALID_ARGUMENT", F.lit(False)), "Request rejected: unsupported shape.")
        .when(verdict == S.BLOCKED, "Blocked at the gateway.")
        .when(status == 503, "Held back: screening could not finish (fail closed).")
        .otherwise("Request failed.")
    )


def filter_chips(verdict, filters, names=S.CHIP_FILTERS):
    """hit, pass or unknown per filter; pass only where the filters are known to have run."""
    hits = F.array_distinct(F.transform(filters, X.base_filter))
    known = (verdict == S.ALLOWED) | ((verdict == S.BLOCKED) & (F.size(filters) > 0))
    return [
        F.when(F.array_contains(hits, name), "hit").when(known, "pass").otherwise("unknown").alias(name)
        for name in names
    ]


def combine_modes(native, callout):
    """One verdict for both modes; a missing one counts as an error, disagreement is mixed."""
    both = lambda v: (native == v) & (callout == v)
    failed = lambda v: v.isNull() | (v == S.ERROR)
    return (
        F.when(both(S.BLOCKED), S.BLOCKED)
        .when(both(S.ALLOWED), S.ALLOWED)
        .when(failed(native) & failed(callout), S.ERROR)
        .otherwise(S.MIXED)
    )
