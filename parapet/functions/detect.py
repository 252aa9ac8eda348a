"""Rule-based detectors. One scan per rule, no shuffle, no Python."""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import scalars as X

# Same matches as the plain pattern, in linear time; the plain forms are quadratic on long
# unbroken runs. E-mail: a local part is only tried where a run of its characters starts
# (or right behind the last match), and the run is never given back. Link: a run without
# blanks is read once from its start, and only its first address is looked at, as every
# later one is part of what follows the first.
_LINK_START = r"(?i)(?<!\S)(?>\S*?(?=https?://))"
_LINK_REST = r"https?://\S*?(?:testsafebrowsing|malware|phishing)"
_LINEAR_FORMS = {
    "malicious_uris": _LINK_START + _LINK_REST,
    "EMAIL_ADDRESS": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
# What a match must start with or contain. Looking for that first is several times
# cheaper than trying every alternative, or a word boundary, at every character.
_STARTS = {
    S.PROMPT_RULES[0]: "idsj",
    S.PROMPT_RULES[2]: "wies",
    S.PROMPT_RULES[3]: r"\d",
    S.UPLOAD_RULES[0]: "idso",
    S.UPLOAD_RULES[1]: "fsabiw",
}
_CONTAINS = {S.PROMPT_RULES[1]: "://", S.INFO_TYPES[4]: "@"}


def _guarded(rule):
    if rule == S.PROMPT_RULES[1]:
        return _LINEAR_FORMS["malicious_uris"]
    starts, (_, pattern) = _STARTS.get(rule), rule
    if starts is None:
        return pattern
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flag}(?=[{starts}])(?:{pattern[len(flag):]})"


def matches(text, rule):
    """Whether a (name, pattern) rule matches; a missing text does not."""
    found = text.rlike(_guarded(rule))
    return F.contains(text, F.lit(_CONTAINS[rule])) & found if rule in _CONTAINS else found


def may_contain(text, rule):
    """Whether a text holds what every match of the rule must contain; true where nothing is known."""
    return F.contains(text, F.lit(_CONTAINS[rule])) if rule in _CONTAINS else text.isNotNull()


def type_pattern(info_type, pattern):
    return _LINEAR_FORMS.get(info_type, pattern)


def all_hits(text, rules=S.PROMPT_RULES):
    """Names of every rule that matches, in rule order."""
    return F.array_compact(F.array(*[F.when(matches(text, rule), F.lit(rule[0])) for rule in rules]))


def first_hit(text, rules=S.PROMPT_RULES, scenario=None, scenarios=S.SCENARIOS):
    """First matching rule only; an unchanged scenario prompt uses that scenario's filter."""
    hit = F.coalesce(*[F.when(matches(text, rule), F.lit(rule[0])) for rule in rules])
    if scenario is None:
        return hit
    prompts = {s[0]: s[3] for s in scenarios}
    filters = {s[0]: s[2] for s in scenarios if s[2]}
    return F.when(
        F.coalesce(X.lookup(prompts, scenario) == text, F.lit(False)), X.lookup(filters, scenario)
    ).otherwise(hit)


def screen_verdict(hits, text, max_chars=S.MAX_TEXT_CHARS):
    """Blocked on any hit; text that is missing or too long to screen is incomplete."""
    return (
        F.when(F.size(hits) > 0, S.BLOCKED)
        .when(text.isNull() | (F.length(text) > max_chars), S.INCOMPLETE)
        .otherwise(S.ALLOWED)
    )


def names_or_none(names):
    return F.when(F.size(names) > 0, F.array_join(names, ",")).otherwise("none")


def screen(df, text="text", rules=S.PROMPT_RULES, max_chars=S.MAX_TEXT_CHARS):
    """Adds `hits` (rule names) and `verdict`. Each pattern runs once per row."""
    screened = df.withColumn("hits", all_hits(F.col(text), rules)).withColumn(
        "verdict", screen_verdict(F.col("hits"), F.col(text), max_chars)
    )
    return X.computed_once(screened, "hits", "verdict")


def bad_links(text):
    """The links the rule matches, whole."""
    links = F.regexp_extract_all(text, F.lit(f"{_LINK_START}({_LINK_REST}\\S*)"), F.lit(1))
    return F.when(F.contains(text, F.lit("://")), links).otherwise(X.empty_strings())


def type_counts(text, info_types=S.INFO_TYPES):
    """Array of (info_type, n) with the number of findings of each type, never the text."""

    def count(rule):
        n = F.regexp_count(text, F.lit(type_pattern(*rule))).cast("bigint")
        return F.when(F.contains(text, F.lit(_CONTAINS[rule])), n).otherwise(F.lit(0)) if rule in _CONTAINS else n

    return F.array(*[F.struct(F.lit(rule[0]).alias("info_type"), count(rule).alias("n")) for rule in info_types])


def findings(df, text="text", keep=()):
    """One row per item and info type found."""
    return df.select(*keep, F.inline(F.filter(type_counts(F.col(text)), lambda t: t.n > 0)))


def above_threshold(info_type, confidence, template=S.TEMPLATE):
    """True when the template has the type enabled and the confidence reaches its threshold."""
    wanted = {t: S.THRESHOLDS[level] for t, (enabled, level) in template.items() if enabled}
    if not wanted:
        return F.lit(False)
    return F.coalesce(X.lookup(S.CONFIDENCE, confidence) >= X.lookup(wanted, info_type), F.lit(False))


def redact_text(text, info_types=S.INFO_TYPES):
    """Every finding replaced by its type name in square brackets."""
    for rule in info_types:
        text = F.regexp_replace(text, type_pattern(*rule), f"[{rule[0]}]")
    return text
