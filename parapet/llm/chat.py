"""Chat formatting from event logs, with DataFrame functions only."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN = "<|im_start|>"
CLOSE = "<|im_end|>\n"
KINDS = ("open", "regenerate", "edit", "delta")
TRAINED = "assistant"


def escape(text):
    """No control string is left in the result, and `unescape` gives the text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text):
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role):
    return F.replace(escape(role), F.lit("\n"), F.lit("<|nl|>"))


def unescape_role(role):
    return unescape(F.replace(role, F.lit("<|nl|>"), F.lit("\n")))


def turn_events(turns):
    """Finished turns as a log: each row opens a message of its own, in the order of turn.

    Rows with the same turn are separate messages, ordered by role and text.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", "turn", "role", "text").repartition("conv_id").select(
        "conv_id",
        F.row_number().over(order).cast("bigint").alias("seq"),
        F.row_number().over(order).cast("bigint").alias("message"),
        F.lit("open").alias("kind"), "role", "text",
    )


def fold(events):
    """Final messages (conv_id, message, seq, role, text) of logs (conv_id, seq, message, kind, role, text).

    In the order of seq, `open` and `edit` set a message's text, `regenerate` empties it,
    `delta` appends. What stands before the last setting event is dropped; the texts after
    it are joined. The role is the first one that is not null, else empty; null texts are
    empty; unknown kinds are ignored; ties in seq keep the order of KINDS.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    known = events.where(F.col("kind").isin(*KINDS)).select(
        "conv_id", "message",
        F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), "role").alias("event"),
    )
    log = known.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("event")).alias("log"))
    start = F.aggregate(
        F.transform("log", lambda e, i: F.when(e["rank"] < len(KINDS), i).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b)
    )
    kept = F.slice("log", F.col("start") + 1, F.size("log"))
    parts = F.transform(kept, lambda e: F.when(e["rank"] == KINDS.index("regenerate") + 1, F.lit("")).otherwise(e["text"]))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return log.withColumn("start", start).select(
        "conv_id", "message", F.col("log")[0]["seq"].alias("seq"),
        F.coalesce(F.get(roles, 0), F.lit("")).alias("role"), F.array_join(parts, "").alias("text"),
    )


def render(messages):
    """One formatted text per conversation, with the spans (from, length; code points) under the loss mask.

    Each turn is `<|im_start|>role`, a line break, the escaped text, `<|im_end|>` and a line
    break. The loss covers the texts of the assistant's turns, without their markers.
    A conversation is one row of the result, so its text is held in one place by its nature.
    """
    turn = F.struct("seq", "message", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    conv = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(CLOSE))), "")
    sizes = F.transform("turns", lambda t: F.struct(
        F.length(head(t)).alias("head"), F.length(t["text"]).alias("text"), (t["role"] == TRAINED).alias("trained"),
    ))
    fresh = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<from:int,length:int>>").alias("spans"))
    walk = F.aggregate(
        "sizes", fresh,
        lambda a, t: F.struct(
            (a["at"] + t["head"] + t["text"] + len(CLOSE)).alias("at"),
            F.when(t["trained"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + t["head"]).cast("int").alias("from"), t["text"].cast("int").alias("length")
            )))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return conv.withColumn("sizes", sizes).select("conv_id", formatted.alias("formatted"), walk.alias("loss_spans"))


def read_back(rendered):
    """Roles, texts and trained text of formatted conversations, from the output alone."""
    body = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")
    cut = F.transform(body, lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    turns = F.transform(cut, lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, F.lit("\n")) + 1)).alias("text"),
    ))
    trained = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["from"], s["length"])))
    return rendered.select("conv_id", "formatted", turns.alias("turns"), F.array_join(trained, "").alias("trained"))


def format_conversations(turns):
    """Formatted conversations of finished turns, by way of the event log."""
    return render(fold(turn_events(turns)))


def digest(rendered):
    """What a reader gets back from each formatted conversation, as counts and hashes."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(rendered).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
