"""Request validation: first failure wins, reasons are fixed text.

Requests are one row each with their parts as an array, so nothing here shuffles.
"""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import scalars as X

CONTENTS_TYPE = "array<struct<role:variant,parts:array<struct<text:variant,inlineData:variant>>>>"
PART_TYPE = "struct<kind:string,text:string,mime:string,data:string>"
FACTS = ("kind", "mime", "chars", "blank", "base64_ok")

BAD_BASE64 = "A file's data must be standard base64 and must not be empty."
NEEDS_CALLOUT = "Native mode reads text parts; a file can be checked in callout mode."
BAD_SINGLE_TYPE = "One file may be application/pdf, text/plain or text/csv."
TEXT_REQUIRED = "One part must be text: a question or an instruction."
PART_TOO_LARGE = "No file may exceed 4 MB."


def single_shape_reason(max_chars):
    return (
        f"A request is one user content of one part: text of 1 to {max_chars} characters, "
        "or one inlineData file in callout mode."
    )


def multi_shape_reason(max_chars, max_files):
    return (
        f"A request is one user content of one text (up to {max_chars} characters) and up to {max_files} "
        "inlineData files of 4 MB (PNG, JPEG, BMP, PDF, TXT, CSV, DOCX, XLSX, PPTX)."
    )


def normalize_mode(mode, default="native"):
    """Two modes; anything unknown is the default of the pipeline."""
    other = "callout" if default == "native" else "native"
    return F.when(F.lower(F.trim(mode)) == other, other).otherwise(default)


def normalize_action(action, default="redact"):
    default = default if default in ("block", "redact") else "redact"
    wanted = F.lower(F.trim(action))
    return F.when(wanted.isin("block", "redact"), wanted).otherwise(default)


def route_flow(path):
    return F.when(path == "/generate-image", "image").otherwise("chat")


def normalize_flow(flow):
    return F.when(flow.isin("chat", "image"), flow).otherwise("chat")


def route(flow, action, chat_model, image_model, inspect_template, redact_template):
    """Model for the flow and template for screening the answer's image."""
    return F.struct(
        F.when(flow == "image", image_model).otherwise(chat_model).alias("model"),
        F.when(action == "redact", redact_template).otherwise(inspect_template).alias("image_template"),
    )


def _string(v):
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _part(p):
    text, inline = _string(p.text), p.inlineData
    is_object = F.schema_of_variant(inline).startswith("OBJECT")
    kind = (
        F.when(text.isNotNull() & inline.isNull(), "text")
        .when(p.text.isNull() & F.coalesce(is_object, F.lit(False)), "file")
        .otherwise("bad")
    )
    mime = F.coalesce(F.try_variant_get(inline, "$.mimeType", "string"), F.lit(""))
    return F.struct(
        kind.alias("kind"),
        text.alias("text"),
        F.lower(mime).alias("mime"),
        _string(F.try_variant_get(inline, "$.data", "variant")).alias("data"),
    )


def parse_requests(df, body):
    """Adds n_contents, role_ok and parts from a JSON body; unreadable JSON gives no contents.

    Only `contents` is read, so every other field of the request ends here.
    """
    contents = F.try_variant_get(F.try_parse_json(body), "$.contents", CONTENTS_TYPE)
    df = df.withColumn("__contents", contents)
    first = F.get(F.col("__contents"), F.lit(0))
    role = first.role
    parts = F.transform(first.parts, _part)
    return df.select(
        *[c for c in df.columns if c != "__contents"],
        F.coalesce(F.size("__contents"), F.lit(0)).alias("n_contents"),
        (role.isNull() | F.coalesce(_string(role) == "user", F.lit(False))).alias("role_ok"),
        F.coalesce(parts, F.expr(f"cast(array() as array<{PART_TYPE}>)")).alias("parts"),
    )


def shape_columns(df, contents):
    """As parse_requests, for requests that are already typed rows (see schemas.CONTENTS)."""
    first = F.get(F.col(contents), F.lit(0))

    def part(p):
        inline = p.inlineData
        kind = F.when(p.text.isNotNull() & inline.isNull(), "text").when(
            p.text.isNull() & inline.isNotNull(), "file"
        ).otherwise("bad")
        mime = F.lower(F.coalesce(inline.mimeType, F.lit("")))
        return F.struct(kind.alias("kind"), p.text.alias("text"), mime.alias("mime"), inline.data.alias("data"))

    return df.select(
        *[c for c in df.columns if c != contents],
        F.coalesce(F.size(contents), F.lit(0)).alias("n_contents"),
        (first.role.isNull() | (first.role == "user")).alias("role_ok"),
        F.coalesce(F.transform(first.parts, part), F.expr(f"cast(array() as array<{PART_TYPE}>)")).alias("parts"),
    )


def part_facts(kind, text, mime, data):
    """What validation needs to know about a part; small, so it may be shuffled."""
    is_file = kind == "file"
    return F.struct(
        kind.alias("kind"),
        mime.alias("mime"),
        F.coalesce(F.when(is_file, F.length(data)).otherwise(F.length(text)), F.lit(0)).cast("bigint").alias("chars"),
        F.coalesce(X.is_blank(text), F.lit(True)).alias("blank"),
        F.coalesce(is_file & X.is_strict_base64(data), F.lit(False)).alias("base64_ok"),
    )


def validate_single(df, mode, max_chars=S.MAX_TEXT_CHARS, max_file_b64=S.MAX_FILE_B64):
    """One text, or one file in callout mode. Adds ok, reason and input (text or file:KIND)."""
    p = F.get(F.col("parts"), F.lit(0))
    one = (F.col("n_contents") == 1) & F.col("role_ok") & (F.size("parts") == 1)
    shape = F.lit(single_shape_reason(max_chars))
    kinds = {m: S.MIME_TYPES[m][0] for m in S.SINGLE_FILE_MIMES}
    file_reason = (
        F.when(mode != "callout", NEEDS_CALLOUT)
        .when(~p.mime.isin(S.SINGLE_FILE_MIMES), BAD_SINGLE_TYPE)
        .when(~F.coalesce(X.is_strict_base64(p.data), F.lit(False)), BAD_BASE64)
        .when(F.length(p.data) > max_file_b64, f"The file is longer than {max_file_b64} base64 characters.")
    )
    text_ok = ~X.is_blank(p.text) & (F.length(p.text) <= max_chars)
    reason = (
        F.when(~one | (p.kind == "bad"), shape)
        .when(p.kind == "file", file_reason)
        .when(~text_ok, shape)
    )
    df = X.computed_once(df.withColumn("reason", reason), "reason").withColumn("ok", F.col("reason").isNull())
    is_file = F.col("ok") & (p.kind == "file")
    return df.withColumn(
        "input", F.when(is_file, F.concat(F.lit("file:"), X.lookup(kinds, p.mime))).otherwise("text")
    )


def facts_reason(facts, max_chars=S.MAX_TEXT_CHARS, max_files=S.MAX_FILES, max_part=S.MAX_PART_B64,
                 max_total=S.MAX_TOTAL_B64):
    """First failure among a request's parts in order, null when it is fine."""
    shape = F.lit(multi_shape_reason(max_chars, max_files))

    def one(p, i):
        upto = F.slice(facts, F.lit(1), i + 1)
        files = F.filter(upto, lambda q: q.kind == "file")
        total = F.aggregate(files, F.lit(0).cast("bigint"), lambda a, q: a + q.chars)
        earlier_text = F.exists(F.slice(facts, F.lit(1), i), lambda q: q.kind == "text")
        return (
            F.when(p.kind == "bad", shape)
            .when((p.kind == "text") & (earlier_text | p.blank | (p.chars > max_chars)), shape)
            .when(p.kind == "text", F.lit(None))
            .when(~p.mime.isin(list(S.MIME_TYPES)),
                  F.concat(F.lit("This file type is not accepted: "), F.left(p.mime, F.lit(80)), F.lit(".")))
            .when(~p.base64_ok, BAD_BASE64)
            .when(F.size(files) > max_files, shape)
            .when(p.chars > max_part, PART_TOO_LARGE)
            .when(total > max_total, f"The files are longer than {max_total} base64 characters together.")
        )

    failures = F.filter(F.transform(facts, one), lambda r: r.isNotNull())
    return (
        F.when((F.size(facts) < 1) | (F.size(facts) > 1 + max_files), shape)
        .when(F.size(failures) > 0, F.get(failures, F.lit(0)))
        .when(~F.exists(facts, lambda p: p.kind == "text"), TEXT_REQUIRED)
    )


def validate_multipart(df, max_chars=S.MAX_TEXT_CHARS, max_files=S.MAX_FILES, max_part=S.MAX_PART_B64,
                       max_total=S.MAX_TOTAL_B64):
    """One text and up to max_files files. Adds ok and reason."""
    facts = F.transform("parts", lambda p: part_facts(p.kind, p.text, p.mime, p.data))
    shape = F.lit(multi_shape_reason(max_chars, max_files))
    df = X.computed_once(df.withColumn("__facts", facts), "__facts").withColumn(
        "reason",
        F.when((F.col("n_contents") != 1) | ~F.col("role_ok"), shape).otherwise(
            facts_reason(F.col("__facts"), max_chars, max_files, max_part, max_total)
        ),
    )
    return X.computed_once(df.withColumn("ok", F.col("reason").isNull()).drop("__facts"), "ok", "reason")


def gather_facts(df, keys, pos, facts, max_parts):
    """Requests from part rows: n_parts, n_files and total_base64 of all parts, and the facts of
    positions 0..max_parts-1 in order, which is what decides.

    One slot per position, each a plain maximum: partial aggregation keeps at most
    max_parts small structs per request and task, however many rows a request has.
    Only facts travel, never the text or the bytes.
    """
    slots = [F.max(F.when(F.col(pos) == i, F.col(facts))).alias(f"__{i}") for i in range(max_parts)]
    is_file = F.col(f"{facts}.kind") == "file"
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_parts"), F.count_if(is_file).alias("n_files"),
        F.coalesce(F.sum(F.when(is_file, F.col(f"{facts}.chars"))), F.lit(0)).cast("bigint").alias("total_base64"), *slots,
    )
    return grouped.select(
        *keys, "n_parts", "n_files", "total_base64", F.array_compact(F.array(*[F.col(f"__{i}") for i in range(max_parts)])).alias("facts")
    )


def validate_part_rows(df, keys, pos, facts, max_chars=S.MAX_TEXT_CHARS, max_files=S.MAX_FILES,
                       max_part=S.MAX_PART_B64, max_total=S.MAX_TOTAL_B64):
    """As validate_multipart, for requests stored as one row per part (pos from 0)."""
    rows = gather_facts(df, keys, pos, facts, 1 + max_files)
    too_many = F.col("n_parts") > 1 + max_files
    reason = F.when(too_many, multi_shape_reason(max_chars, max_files)).otherwise(
        facts_reason(F.col("facts"), max_chars, max_files, max_part, max_total)
    )
    return rows.select(
        *keys,
        "n_parts",
        "n_files",
        "total_base64",
        reason.isNull().alias("ok"),
        reason.alias("reason"),
    )


def decoded_size(data):
    """Exact decoded size of strict base64, without decoding it."""
    padding = F.length(data) - F.length(F.rtrim(data, F.lit("=")))
    return (F.length(data) / 4 * 3).cast("bigint") - padding


def validate_upload(df, filename="filename", data="data_base64", max_bytes=S.MAX_UPLOAD_BYTES):
    """One uploaded document. Adds safe_name, ext, mime, kind, bytes, status, reason."""
    name, b64 = F.col(filename), F.col(data)
    df = df.withColumn("safe_name", X.safe_filename(name, "upload")).withColumn("ext", X.extension(F.col("safe_name")))
    mimes = {e: t[0] for e, t in S.UPLOAD_TYPES.items()}
    kinds = {e: t[1] for e, t in S.UPLOAD_TYPES.items()}
    strict = X.is_strict_base64(b64)
    head = X.from_base64(F.left(b64, F.lit(1368)))
    allowed = ", ".join(sorted(S.UPLOAD_TYPES))
    df = df.withColumn("mime", X.lookup(mimes, F.col("ext"))).withColumn("kind", X.lookup(kinds, F.col("ext")))
    df = df.withColumn("bytes", F.when(F.col("mime").isNotNull() & strict, decoded_size(b64)))
    reason = (
        F.when(F.coalesce(F.length(name), F.lit(0)).between(1, 255) == F.lit(False), "filename is required")
        .when(F.col("mime").isNull(), f"This file type is not accepted; known are {allowed}")
        .when(F.coalesce(F.length(b64), F.lit(0)) == 0, "dataBase64 is required")
        .when(F.col("bytes").isNull(), "dataBase64 is no standard base64")
        .when(F.col("bytes") > max_bytes, F.concat(F.lit("File exceeds "), X.fmt_bytes(F.lit(max_bytes))))
        .when((F.col("ext") == ".pdf") & ~X.has_pdf_magic(head), "This is not a valid PDF file")
        .when((F.col("ext") != ".pdf") & X.decode_utf8(X.from_base64(b64)).isNull(), "Text files must be UTF-8")
    )
    df = df.withColumn("reason", reason)
    too_big = F.col("reason").startswith("File exceeds")
    return df.withColumn("status", F.when(F.col("reason").isNull(), 200).when(too_big, 413).otherwise(400))


def validate_attachments(df, files="files", max_files=S.MAX_FILES, max_bytes=S.MAX_ATTACHMENT_BYTES,
                         max_total=S.MAX_ATTACHMENTS_BYTES):
    """Attachments as array<struct<name, dataBase64>>. Adds attachments (name, mime, bytes), ok, reason."""
    types = S.ATTACHMENT_TYPES

    def meta(f):
        name = X.safe_filename(f["name"], "file")
        strict = F.coalesce(X.is_strict_base64(f.dataBase64), F.lit(False))
        return F.struct(
            name.alias("name"),
            X.extension(name).alias("ext"),
            X.lookup(types, X.extension(name)).alias("mime"),
            F.when(strict, decoded_size(f.dataBase64)).alias("bytes"),
            f.dataBase64.alias("raw"),
        )

    df = df.withColumn("__meta", F.coalesce(F.transform(files, meta), F.expr(
        "cast(array() as array<struct<name:string,ext:string,mime:string,bytes:bigint,raw:string>>)")))
    metas = F.col("__meta")

    def one(m, i):
        total = F.aggregate(F.slice(metas, F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, q: a + F.coalesce(q.bytes, F.lit(0)))
        return (
            F.when(m.mime.isNull(), F.concat(F.lit("'"), m.ext, F.lit(f"' files are not accepted; known are {', '.join(sorted(types))}.")))
            .when(m.raw.isNull(), F.concat(m["name"], F.lit(": dataBase64 must be a base64 string.")))
            .when(m.raw == "", F.concat(m["name"], F.lit(" is empty.")))
            .when(m.bytes.isNull(), F.concat(m["name"], F.lit(": dataBase64 is no standard base64.")))
            .when(m.bytes > max_bytes, F.concat(m["name"], F.lit(" exceeds 4 MB.")))
            .when(total > max_total, "The files exceed 5 MB together.")
        )

    failures = F.filter(F.transform(metas, one), lambda r: r.isNotNull())
    reason = F.when(F.size(metas) > max_files, f"No more than {max_files} files.").otherwise(F.get(failures, F.lit(0)))
    return (
        df.withColumn("reason", reason)
        .withColumn("ok", F.col("reason").isNull())
        .withColumn("attachments", F.transform(
            metas, lambda m: F.struct(m["name"].alias("name"), m.mime.alias("mime"), m.bytes.alias("bytes"))
        ))
        .drop("__meta")
    )


def validate_prompt(df, prompt="prompt", scenario="scenario_id", default="custom", scenarios=S.SCENARIOS,
                    max_chars=S.MAX_PROMPT_CHARS, prefix="prompt_"):
    """Typed prompt, or the scenario's own when none is given. Adds text, scenario, ok, reason."""
    sid = F.coalesce(F.nullif(F.col(scenario), F.lit("")), F.lit(default))
    own = X.lookup({s[0]: s[3] for s in scenarios}, sid)
    text = F.coalesce(F.nullif(F.col(prompt), F.lit("")), own, F.lit(""))
    df = df.withColumn(f"{prefix}scenario", F.when(own.isNotNull(), sid).otherwise(default)).withColumn(f"{prefix}text", text)
    t = F.col(f"{prefix}text")
    reason = (
        F.when(~sid.rlike(r"^[a-z0-9-]{1,64}\z"), "invalid scenarioId")
        .when(X.is_blank(t), "a prompt must hold text")
        .when(F.length(t) > max_chars, f"a prompt is limited to {max_chars} characters")
    )
    return df.withColumn(f"{prefix}reason", reason).withColumn(f"{prefix}ok", F.col(f"{prefix}reason").isNull())


def native_prompt(name, text, instruction=S.FILE_INSTRUCTION):
    """Instruction, document header and text, as the text-only mode sends a document."""
    before, after = S.DOCUMENT_HEADER.split("{name}")
    return F.concat(F.lit(f"{instruction}\n\n{before}"), name, F.lit(f"{after}\n"), text)


def native_skip(text, prompt, max_chars=S.MAX_TEXT_CHARS, note=None):
    """Reason for not sending a document to the text-only mode, null when it is sent.

    Over-long text is never cut to fit: the cut part would go unscreened.
    """
    detail = F.lit("") if note is None else F.coalesce(F.concat(F.lit(" ("), note, F.lit(")")), F.lit(""))
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0,
               F.concat(F.lit("The file holds no text"), detail, F.lit("; there was nothing to check.")))
        .when(F.length(prompt) > max_chars,
              F.concat(F.lit("A prompt of "), X.fmt_thousands(F.length(prompt)),
                       F.lit(f" characters is above the {max_chars:,} that native mode takes; cut, a part of it would go unchecked.")))
    )
