"""Scalar helpers: Column in, Column out, all of them built-in expressions."""

import string

from pyspark.sql import functions as F

from parapet import settings as S

EMPTY_STRINGS = "cast(array() as array<string>)"


def computed_once(df, *names, **values):
    """The same rows, with the named columns (or new values) fixed where they are.

    A filter on a computed column is normally pushed below the computation and repeats
    it. For columns that scan whole texts that doubles the work; behind a one-row
    generator a filter stays above.
    """
    rest = [c for c in df.columns if c not in names and c not in values]
    fixed = [*names, *[value.alias(name) for name, value in values.items()]]
    return df.select(*rest, F.inline(F.array(F.struct(*fixed))))


def let(value, body):
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_strings():
    return F.expr(EMPTY_STRINGS)


def lookup(table, key):
    """Value of a small fixed dict for a key column, null when absent."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), key)


def is_blank(text):
    """No character left once all Unicode white space is ignored."""
    return ~text.rlike(r"[^\s\p{Z}\x{FEFF}]")


def strip(text):
    """Without leading and trailing white space of any kind.

    The text is named more than once: give a column that is there, not a long expression. Most
    texts have no blank at either end, which two characters show.
    """
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    stripped = F.regexp_replace(text, r"\A[\s\p{Z}\x{FEFF}]++|(?<![\s\p{Z}\x{FEFF}])[\s\p{Z}\x{FEFF}]++\z", "")
    return F.when(ends.rlike(r"[\s\p{Z}\x{FEFF}]"), stripped).otherwise(text)


def is_strict_base64(data):
    """Non-empty, length a multiple of four, standard alphabet, padding at the end.

    Spark's own decoder also takes white space and missing padding, so it cannot
    replace this check.
    """
    return (F.length(data) > 0) & (F.length(data) % 4 == 0) & data.rlike(r"^[A-Za-z0-9+/]++={0,2}\z")


def encode_base64(content):
    """One unbroken line, whether or not the encoder of this Spark version wraps lines."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def from_base64(data):
    return F.try_to_binary(data, F.lit("base64"))


def base64_bytes(data):
    """Size estimate floor(len * 3 / 4): padding is not subtracted."""
    return F.floor(F.length(data) * 3 / 4)


# fixed value: the characters of a label
LABEL = string.ascii_letters + string.digits + "_:,.- "


def clean_label(value, n=120):
    """Short printable label for values taken from headers and logs.

    Most values are labels already, which an anchored pattern sees at once. Of others, what is left
    without the characters of a label is taken out. On short values both are several times cheaper
    than a search and replace.
    """
    value = F.coalesce(value, F.lit(""))
    cleaned = F.call_function("translate", value, F.translate(value, LABEL, ""), F.lit(""))
    return F.left(F.when(value.rlike(r"\A[A-Za-z0-9_:,.\- ]*+\z"), value).otherwise(cleaned), F.lit(n))


def mask_secret(key):
    """At most the last four characters of a secret."""
    return (
        F.when(F.coalesce(F.length(key), F.lit(0)) == 0, "")
        .when(F.length(key) > 8, F.concat(F.lit("••••"), F.right(key, F.lit(4))))
        .otherwise("••••")
    )


def mask_secret_ends(key):
    """First and last four characters of a long secret, else a fixed note."""
    return F.when(
        F.length(key) > 12, F.concat(F.left(key, F.lit(4)), F.lit("…"), F.right(key, F.lit(4)))
    ).otherwise("(not set)")


def fmt_bytes(n):
    """KB with one decimal below 1 MiB, else MB with two; exact halves round to even."""
    kib = 1024.0
    return F.when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / kib, 1))).otherwise(
        F.format_string("%.2f MB", F.bround(n / (kib * kib), 2))
    )


def fmt_thousands(n):
    return F.format_number(n, 0)


def int_or(value, default=None):
    """Integer from untrusted text, else the default."""
    number = F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), value.try_cast("bigint"))
    return number if default is None else F.coalesce(number, F.lit(default))


def int_or_null(value):
    """Integer from untrusted text; garbage and zero give null."""
    return F.nullif(int_or(value), F.lit(0).cast("bigint"))


def string_list(json_array, n=60):
    """Strings of a JSON array, each cut to n characters; anything else is dropped."""
    items = F.from_json(json_array, "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(
        F.transform(strings, lambda v: F.left(F.try_variant_get(v, "$", "string"), F.lit(n))),
        empty_strings(),
    )


def json_or(text, default):
    """The text itself when it is JSON, else the default text."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.lit(default))


def base_filter(name):
    return F.split_part(name, F.lit(":"), F.lit(1))


def filter_label(name):
    """Display name of a filter, with its sub-type in brackets."""
    label = lookup(S.FILTER_LABELS, base_filter(name))
    sub = F.split_part(name, F.lit(":"), F.lit(2))
    return F.coalesce(
        F.when(sub == "", label).otherwise(F.concat(label, F.lit(" ("), sub, F.lit(")"))), name
    )


def sniff_image(data, otherwise):
    """Image type from the first base64 characters."""
    return (
        F.when(data.startswith("/9j/"), "image/jpeg")
        .when(data.startswith("iVBOR"), "image/png")
        .otherwise(otherwise)
    )


def safe_filename(name, fallback):
    base = F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)
    kept = F.left(F.regexp_replace(base, r"[^A-Za-z0-9._ ()-]", "_"), F.lit(120))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def extension(name):
    """Lower-case extension with its dot, '' when there is none (leading dots do not count)."""
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))


def has_pdf_magic(content):
    return F.locate("%PDF-", F.decode(F.substring(content, 1, 1024), "ISO-8859-1")) > 0


def decode_utf8(content):
    """Strict UTF-8 text without a byte order mark, null when the bytes are not UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")


def check_millis(start_ms, end_ms):
    """Elapsed milliseconds, never negative; unknown or non-positive start gives 0."""
    return F.when(start_ms > 0, F.greatest(F.lit(0), end_ms - start_ms)).otherwise(F.lit(0))


def epoch_micros(ts):
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def latency_delta(a, b):
    """b - a, only where both were measured."""
    return F.when((a > 0) & (b > 0), F.round(b - a))


def forwarded_state(n, forwarded):
    return F.when(n.isNull(), "n/a").when(~forwarded, "note only").otherwise("yes")


def _trim_lines(text):
    # The look-behinds start a match only where a blank run starts: linear on long runs.
    text = F.regexp_replace(text, r"(?<![\s\p{Z}])[\s\p{Z}]*\n[\s\p{Z}]*", "\n")
    return F.regexp_replace(text, r"\A[\s\p{Z}]++|(?<![\s\p{Z}])[\s\p{Z}]++\z", "")


def normalize_lines(text, max_chars=None):
    """Trim lines, squeeze blanks, drop empty lines and non-printable characters."""
    text = F.regexp_replace(text, r"[\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n")
    # A single blank is no match: it would be put in its own place.
    text = F.regexp_replace(text, r"[\t\x{A0}][ \t\x{A0}]*+| [ \t\x{A0}]++", " ")
    text = _trim_lines(text)
    text = F.regexp_replace(text, r"[\p{C}\p{Z}&&[^\n ]]+", "")
    return text if max_chars is None else F.left(text, F.lit(max_chars))


def normalize_column(name):
    """`normalize_lines` of a column that is there. Most texts hold no character and no two blanks
    that its first, second and last step would change; one look shows it."""
    text = F.col(name)
    odd = text.rlike(r"[\p{C}\p{Z}&&[^\n ]]|  ")
    return F.when(odd, normalize_lines(text)).otherwise(_trim_lines(text))


def describe_prompt(chars):
    return F.concat(F.lit("<prompt, "), fmt_thousands(chars), F.lit(" chars>"))


def describe_base64(chars):
    return F.concat(F.lit("<base64, "), fmt_thousands(chars), F.lit(" chars>"))
