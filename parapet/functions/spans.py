"""Findings by position: where each type matches, overlaps joined by one stated rule, texts cut once.

Offsets count code points, ends are exclusive. Positions come from the lengths of what lies
between matches; running sums go over blocks, so that a text with very many findings does
not take quadratic time.
"""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import scalars as X
from parapet.functions.detect import may_contain, type_pattern

BLOCK = 256
SPAN = "array<struct<start:int,end:int,info_type:string>>"
JOINED = "array<struct<start:int,end:int,info_type:string,n:int>>"


def running(values, merge, zero):
    """For each place of an array, `merge` over all earlier values."""
    whole = lambda v: F.aggregate(v, zero, merge)
    place = lambda v, b, i: merge(
        whole(F.slice(b, F.lit(1), F.floor(i / BLOCK).cast("int"))),
        whole(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)),
    )
    blocks = lambda v: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: whole(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    )
    places = lambda v: X.let(blocks(v), lambda b: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: place(v, b, i)))
    return X.let(values, lambda v: F.when(F.size(v) > 0, places(v)).otherwise(F.array().cast("array<int>")))


def type_spans(text, info_type, pattern):
    """Spans of one type's matches, in order; none for a missing text."""
    form = type_pattern(info_type, pattern)
    both = F.struct(F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("found"), F.split(text, form, -1).alias("between"))

    def placed(x):
        sizes = F.transform(x["found"], lambda m, i: F.length(m) + F.length(F.get(x["between"], i)))
        return X.let(running(sizes, lambda a, b: a + b, F.lit(0)), lambda before: F.transform(x["found"], lambda m, i: X.let(
            F.get(before, i) + F.length(F.get(x["between"], i)),
            lambda start: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(info_type).alias("info_type")),
        )))

    return F.when(F.coalesce(may_contain(text, (info_type, pattern)), F.lit(False)), X.let(both, placed)).otherwise(F.array()).cast(SPAN)


def finding_spans(text, info_types=S.INFO_TYPES):
    """All findings of all types by start; of those that start together the longer first, then by type name."""
    key = F.transform(F.concat(*[type_spans(text, *rule) for rule in info_types]), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("order"), s["info_type"].alias("info_type"), s["end"].alias("end")
    ))
    return F.transform(F.array_sort(key), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["info_type"].alias("info_type"))).cast(SPAN)


def join_overlaps(spans):
    """Overlapping spans as one: it covers them all and is named after the longest, then the first, then by type name.

    One sweep by start: a span opens a new one where it starts at or behind the furthest end so far.
    """
    def opened(all_, ends):
        starts = F.filter(F.transform(all_, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(ends, i)), i)), lambda i: i.isNotNull())
        return X.let(starts, lambda at: F.transform(at, lambda a, k: X.let(
            F.slice(all_, a + 1, F.coalesce(F.get(at, k + 1), F.size(all_)) - a), one
        )))

    def one(group):
        order = F.transform(group, lambda s: F.struct((s["start"] - s["end"]).alias("size"), s["start"].alias("start"), s["info_type"].alias("info_type")))
        return F.struct(
            group[0]["start"].alias("start"), F.array_max(F.transform(group, lambda s: s["end"])).alias("end"),
            F.array_min(order)["info_type"].alias("info_type"), F.size(group).alias("n"),
        )

    furthest = lambda all_: running(F.transform(all_, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    return X.let(spans, lambda all_: F.when(F.size(all_) == 0, F.array().cast(JOINED)).otherwise(
        X.let(furthest(all_), lambda ends: opened(all_, ends)).cast(JOINED)
    ))


def cut(text, joined):
    """The text with each joined span replaced by its type name in square brackets."""

    def pieces(chars, spans):
        before = F.transform(spans, lambda s, i: F.concat(
            F.array_join(F.slice(chars, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))), ""),
            F.lit("["), s["info_type"], F.lit("]"),
        ))
        rest = F.array_join(F.slice(chars, F.element_at(spans, -1)["end"] + 1, F.size(chars)), "")
        return F.concat(F.array_join(before, ""), rest)

    return X.let(joined, lambda spans: F.when(F.size(spans) == 0, text).otherwise(X.let(F.split(text, ""), lambda chars: pieces(chars, spans))))


def redact_spans(text, info_types=S.INFO_TYPES):
    """Every finding replaced by its type; overlapping ones by the rule of `join_overlaps`, whatever the order of the types."""
    return cut(text, join_overlaps(finding_spans(text, info_types)))
