"""Requests and answers to numbered parts and back."""

from pyspark.sql import functions as F

from parapet import settings as S
from parapet.functions import scalars as X

_KINDS = {mime: kind for mime, (kind, _) in S.MIME_TYPES.items()}
_FORWARD_AS = {mime: target for mime, (_, target) in S.MIME_TYPES.items() if target}


def split_parts(df, keys, parts="parts"):
    """One row per part of an accepted request: the text is part 1, files keep their order."""
    ordered = F.concat(
        F.filter(parts, lambda p: p.kind == "text"), F.filter(parts, lambda p: p.kind == "file")
    )
    rows = df.select(*keys, F.posexplode(ordered).alias("__pos", "__part"))
    p = F.col("__part")
    is_text = p.kind == "text"
    return rows.select(
        *keys,
        (F.col("__pos") + 1).alias("n"),
        F.when(is_text, "text").otherwise(X.lookup(_KINDS, p.mime)).alias("kind"),
        F.when(is_text, "text/plain").otherwise(p.mime).alias("mime"),
        F.when(is_text, F.length(p.text)).otherwise(X.base64_bytes(p.data)).cast("bigint").alias("bytes"),
        (is_text | X.lookup(_FORWARD_AS, p.mime).isNotNull()).alias("forwarded"),
        p.text.alias("text"),
        p.data.alias("data"),
    )


def part_records(parts, metadata, keys):
    """Screened parts with what is known about them, and the name a part is shown under.

    `metadata` has one row per part with a file_name, null where none is on record.
    """
    known = parts.join(metadata, [*keys, "n"], "left")
    return known.withColumn("name", part_name(F.col("n"), F.col("file_name"))).drop("file_name")


def part_name(n, file_name=None):
    """What a part is shown under: part 1 is the prompt, a file has its name if that is on record."""
    number = F.concat(F.lit("part "), n.cast("string"))
    return F.when(n == 1, "Prompt text").otherwise(number if file_name is None else F.coalesce(file_name, number))


def last_part_text(contents):
    """Text of the last part of the last content."""
    return F.try_element_at(F.try_element_at(contents, F.lit(-1)).parts, F.lit(-1)).text


def last_answer_text(candidates):
    """Text of the last part of the last candidate."""
    return F.try_element_at(F.try_element_at(candidates, F.lit(-1)).content.parts, F.lit(-1)).text


def _user_payload(parts, image_flow=None):
    content = F.array(F.struct(F.lit("user").alias("role"), parts.alias("parts")))
    fields = [content.alias("contents")]
    if image_flow is not None:
        modalities = F.struct(F.array(F.lit("TEXT"), F.lit("IMAGE")).alias("responseModalities"))
        fields.append(F.when(image_flow, modalities).alias("generationConfig"))
    return F.to_json(F.struct(*fields))


def _text_part(text):
    return F.struct(text.alias("text"), F.lit(None).cast("struct<mimeType:string,data:string>").alias("inlineData"))


def text_payload(text):
    """Forwarded body of a text request: the screened text and nothing else."""
    return _user_payload(F.array(F.struct(text.alias("text"))))


def file_payload(mime, data, instruction):
    """Forwarded body of a file request: a fixed instruction and the same bytes."""
    inline = F.struct(X.lookup(_FORWARD_AS, mime).alias("mimeType"), data.alias("data"))
    part = F.struct(F.lit(None).cast("string").alias("text"), inline.alias("inlineData"))
    return _user_payload(F.array(_text_part(F.lit(instruction)), part))


def multipart_payload(parts, mode, flow):
    """Forwarded body of a multi-part request.

    Text first, then each file: the bytes when the model reads that type, else a note.
    The native mode forwards the text alone.
    """
    text = F.get(F.filter(parts, lambda p: p.kind == "text"), F.lit(0)).text

    def forward(p):
        target, kind = X.lookup(_FORWARD_AS, p.mime), X.lookup(_KINDS, p.mime)
        label = F.coalesce(X.lookup(S.NOTE_LABELS, kind), kind)
        note = F.concat(
            F.lit("[An attached "), label,
            F.lit(" passed screening. This model cannot read that file type, so only this note is shared.]"),
        )
        return F.struct(
            F.when(target.isNull(), note).alias("text"),
            F.when(target.isNotNull(), F.struct(target.alias("mimeType"), p.data.alias("data"))).alias("inlineData"),
        )

    files = F.transform(F.filter(parts, lambda p: p.kind == "file"), forward)
    both = F.when(mode == "native", F.array(_text_part(text))).otherwise(F.concat(F.array(_text_part(text)), files))
    return _user_payload(both, flow == "image")


# --- answers -----------------------------------------------------------------


def _truthy(v):
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        v.isNotNull() & (kind != "VOID") & ~text.isin("false", "0", "") | kind.startswith("OBJECT")
        | kind.startswith("ARRAY"),
        F.lit(False),
    )


def _text_of(part):
    v = F.try_variant_get(part, "$.text", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _inline(part, field):
    v = F.try_variant_get(part, f"$.inlineData.{field}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def screenable(part):
    """A text or inline part that is not model reasoning: the only kinds that may leave."""
    thought = _truthy(F.try_variant_get(part, "$.thought", "variant"))
    inline = _truthy(F.try_variant_get(part, "$.inlineData", "variant"))
    return ~thought & (_text_of(part).isNotNull() | inline)


def split_answer(df, body):
    """Adds what of an answer can be screened: screen_text, image_index/mime/data, shape_ok.

    An unreadable answer, two images, an image of another type or without bytes cannot
    be screened, so its shape is not ok. An answer without parts is ok and empty.
    """
    parsed = F.try_parse_json(body)
    parts = F.try_variant_get(parsed, "$.candidates[0].content.parts", "array<variant>")
    kept = F.transform(
        F.filter(F.coalesce(parts, F.expr("cast(array() as array<variant>)")), screenable),
        lambda p: F.struct(
            _text_of(p).alias("text"),
            _truthy(F.try_variant_get(p, "$.inlineData", "variant")).alias("inline"),
            F.lower(F.coalesce(_inline(p, "mimeType"), F.lit(""))).alias("mime"),
            _inline(p, "data").alias("data"),
        ),
    )
    df = df.withColumns({"__kept": kept, "__read": parsed.isNotNull()})
    indexed = F.transform("__kept", lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    images = F.filter(indexed, lambda x: x.p.inline & x.p.data.isNotNull())
    texts = F.filter(
        F.transform("__kept", lambda p: p.text), lambda t: t.isNotNull() & ~F.coalesce(X.is_blank(t), F.lit(True))
    )
    df = df.withColumns({"__images": images, "__texts": texts})
    first = F.get(F.col("__images"), F.lit(0))
    one_ok = (F.size("__images") == 1) & first.p.mime.isin(S.ANSWER_IMAGE_MIMES)
    no_bytes = F.exists("__kept", lambda p: p.inline & p.data.isNull())
    joined = F.array_join("__texts", "\n")
    has_text, has_image = F.size("__texts") > 0, F.coalesce(one_ok, F.lit(False))
    return df.withColumns({
        "kept_parts": F.size("__kept"),
        "has_text": has_text,
        "screen_text": F.when(has_text, joined),
        "has_image": has_image,
        "shape_ok": F.col("__read") & ~no_bytes & ((F.size("__images") == 0) | has_image),
        "image_index": F.when(has_image, first.i),
        "image_mime": F.when(has_image, first.p.mime),
        "image_data": F.when(has_image, first.p.data),
    }).drop("__kept", "__read", "__images", "__texts")


def answer_text_and_image(body):
    """Display text (no separator) and the first inline image if it has both fields."""
    parts = F.coalesce(
        F.try_variant_get(F.try_parse_json(body), "$.candidates[0].content.parts", "array<variant>"),
        F.expr("cast(array() as array<variant>)"),
    )
    shown = F.filter(parts, lambda p: _text_of(p).isNotNull() & ~_truthy(F.try_variant_get(p, "$.thought", "variant")))
    text = F.array_join(F.transform(shown, _text_of), "")
    is_object = lambda p: F.coalesce(
        F.schema_of_variant(F.try_variant_get(p, "$.inlineData", "variant")).startswith("OBJECT"), F.lit(False)
    )
    first = F.get(F.filter(parts, is_object), F.lit(0))
    data, mime = F.nullif(_inline(first, "data"), F.lit("")), _inline(first, "mimeType")
    image = F.when(
        data.isNotNull() & mime.isNotNull(),
        F.struct(F.left(mime, F.lit(40)).alias("mimeType"), data.alias("dataBase64")),
    )
    return F.struct(text.alias("text"), image.alias("image"))


def _rewrite_parts(body, change):
    """The answer with its first candidate's parts replaced, every other field kept."""
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    new_parts = lambda v: F.to_variant_object(change(as_list(v)))

    def on_key(key, fn):
        return lambda m: F.to_variant_object(
            F.transform_values(as_map(m), lambda k, v: F.when(k == key, fn(v)).otherwise(v))
        )

    content = on_key("content", on_key("parts", new_parts))

    def first_candidate(v):
        return F.to_variant_object(
            F.transform(as_list(v), lambda c, i: F.when(i == 0, content(c)).otherwise(c))
        )

    return F.to_json(on_key("candidates", first_candidate)(F.try_parse_json(body)))


def strip_unscreened(body):
    """The answer without reasoning and without parts that are neither text nor inline data.

    A clean answer comes back unchanged, byte for byte.
    """
    parts = F.try_variant_get(F.try_parse_json(body), "$.candidates[0].content.parts", "array<variant>")
    dirty = F.exists(parts, lambda p: ~screenable(p))
    return F.when(F.coalesce(dirty, F.lit(False)), _rewrite_parts(body, lambda ps: F.filter(ps, screenable))).otherwise(body)


def swap_image(body, index, data):
    """The (stripped) answer with the image at `index` replaced; null when it cannot be."""

    def swap(part):
        mime = X.sniff_image(data, F.try_variant_get(part, "$.inlineData.mimeType", "string"))
        inline = F.struct(mime.alias("mimeType"), data.alias("data"))
        fields = F.map_filter(F.try_variant_get(part, "$", "map<string,variant>"), lambda k, _: k != "inlineData")
        return F.to_variant_object(
            F.map_concat(fields, F.create_map(F.lit("inlineData"), F.to_variant_object(inline)))
        )

    target = F.try_variant_get(F.try_parse_json(body), "$.candidates[0].content.parts", "array<variant>")
    found = F.try_variant_get(F.get(target, index), "$.inlineData", "variant").isNotNull()
    swapped = _rewrite_parts(
        body, lambda ps: F.transform(ps, lambda p, i: F.when(i == index, swap(p)).otherwise(p))
    )
    return F.when(F.coalesce(found, F.lit(False)), swapped)


def fallback_text(body):
    """Text to show for a response of unknown shape."""
    parsed = F.try_parse_json(body)
    get = lambda path: F.try_variant_get(parsed, path, "variant")
    string = lambda path: F.when(F.schema_of_variant(get(path)) == "STRING", F.try_variant_get(parsed, path, "string"))
    parts = F.try_variant_get(parsed, "$.candidates[0].content.parts", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(_text_of(p), F.lit(""))), "")
    has_error = F.when(get("$.error").isNotNull(), F.coalesce(
        string("$.error.message"), F.try_variant_get(parsed, "$.error", "string"), F.get_json_object(body, "$.error")
    ))
    return F.coalesce(
        string("$"), joined, string("$.choices[0].message.content"),
        *[string(f"$.{k}") for k in ("text", "answer", "output", "message")], has_error, body, F.lit("")
    )


def usage_tokens(body):
    """Token counts of an answer, null where not reported."""
    get = lambda name: F.get_json_object(body, f"$.usageMetadata.{name}").try_cast("bigint")
    return F.struct(
        get("promptTokenCount").alias("prompt"),
        get("candidatesTokenCount").alias("completion"),
        get("totalTokenCount").alias("total"),
    )


def describe_input(kind, text_chars, name, mime, size, text, note):
    """Metadata-only preview of what was screened, plus the display excerpt of extracted text."""
    shown = F.when(kind == "text", X.describe_prompt(text_chars)).otherwise(X.describe_base64(F.ceil(size / 3) * 4))
    return F.struct(
        kind.alias("kind"),
        shown.alias("body"),
        name.alias("name"),
        mime.alias("mime"),
        size.alias("bytes"),
        F.length(text).alias("extracted_chars"),
        F.left(text, F.lit(S.PREVIEW_CHARS)).alias("preview"),
        (F.length(text) > S.PREVIEW_CHARS).alias("truncated"),
        note.alias("note"),
    )


def clean_parts(json):
    """Part records from an untrusted header: only objects with an integer part number stay."""
    items = F.from_json(json, "array<variant>")
    get = lambda p, f: F.try_variant_get(p, f"$.{f}", "variant")
    ok = lambda p: F.coalesce(F.schema_of_variant(get(p, "n")) == "BIGINT", F.lit(False))
    string = lambda p, f: F.try_variant_get(p, f"$.{f}", "string")
    return F.transform(
        F.filter(F.coalesce(items, F.expr("cast(array() as array<variant>)")), ok),
        lambda p: F.struct(
            F.try_variant_get(p, "$.n", "bigint").alias("n"),
            F.left(F.coalesce(F.nullif(string(p, "kind"), F.lit("")), F.lit("file")), F.lit(40)).alias("kind"),
            F.left(F.coalesce(string(p, "verdict"), F.lit("")), F.lit(20)).alias("verdict"),
            X.string_list(string(p, "filters")).alias("filters"),
            F.when(F.schema_of_variant(get(p, "ms")) != "BOOLEAN", X.int_or(string(p, "ms"), 0))
            .otherwise(F.lit(0).cast("bigint")).alias("ms"),
        ),
    )


def clean_answer(json):
    """Answer record from an untrusted header; a malformed text or image becomes null."""
    parsed = F.try_parse_json(json)

    def section(name, with_findings):
        v = F.try_variant_get(parsed, f"$.{name}", "variant")
        text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
        fields = [text("verdict").alias("verdict"), X.string_list(text("filters")).alias("filters")]
        if with_findings:
            fields += [text("state").alias("state"), text("action").alias("action"),
                       X.string_list(text("findings")).alias("findings")]
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.struct(*fields)).alias(name)

    body = F.struct(
        F.try_variant_get(parsed, "$.verdict", "string").alias("verdict"), section("text", False), section("image", True)
    )
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), body)
