"""Conversation structure repair: the cheapest edits that make the roles alternate, by divide and conquer.

Role initials must read `(s?(ua)+)?`, which four states accept: nothing yet, after s, after u,
after a. What a run of rows can do is a 4 x 4 table: the least cost from each state to each
state, and the order of the least audits that reach it. Two neighbouring runs meet in a
state where forward plus backward cost is least and, of those, the audit is least; the halves
are then solved between known states (Hirschberg's scheme, all halves of a level at once), so
the space stays linear. Rows are sorted by range; a long conversation is cut wherever a
partition ends, and the cuts are first solved over one table per piece.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parapet.llm.common import stored
from parapet.llm.simhash import whole_tiles

STATES = 4
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INITIALS = ("s", "u", "a", "")  # the last stands for any other
FORCED = 2 * len(INITIALS)  # kind of a row that has to go
FAR = 1 << 40
TAILS = ("", "ua", "a", "")  # rows inserted at the end, by state
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ((0, 1), (1, 2), (2, 1))


def row_edits(kind):
    """{(state before, state after): (cost, edits, inserted initials, new initial)} of one row, the least of each.

    A row that has to go changes no state: an insertion before its deletion could as well come after, where the audit is less.
    """
    found = {}

    def offer(s, t, cost, edits, lead="", to=""):
        found[s, t] = min(found.get((s, t), (FAR, "", "", "")), (cost, edits, lead, to))

    initial, extra = INITIALS[kind % FORCED // 2], TRUNCATED * (kind % 2)
    for s in range(STATES):
        offer(s, s, DELETE, "D")
        if kind == FORCED:
            continue
        if s == 0 and initial == "s":
            offer(0, 1, extra, "K")
        at, lead = s, ""
        for n in range(3):
            t, letter = (3, "a") if at == 2 else (2, "u")
            own, price = ("K", 0) if initial == letter else ("R", REROLE)
            offer(s, t, n * INSERT + price + extra, "I" * n + own, lead, "" if own == "K" else letter)
            lead, at = lead + letter, t
    return found


def pack(cost, order):
    """Costs and audit orders in one number each: ranks within a row tell apart even unreachable states."""
    rank = np.argsort(np.argsort(order, axis=-1, kind="stable"), axis=-1, kind="stable")
    return np.minimum(cost, FAR) * STATES + rank


@functools.cache
def row_tables():
    tables = np.full((FORCED + 1, STATES, STATES), FAR * STATES, dtype=np.int64)
    for kind in range(FORCED + 1):
        edits = row_edits(kind)
        for s in range(STATES):
            audits = [edits.get((s, t), (FAR, "~"))[1] for t in range(STATES)]
            order = np.array([sorted(audits).index(x) for x in audits])
            tables[kind, s] = pack(np.array([edits.get((s, t), (FAR,))[0] for t in range(STATES)]), order)
    return tables


def joined(a, b):
    """Tables of runs followed by runs: least cost, and of equal ones the least audit, over the state in between.

    Audits up to a row are never beginnings of each other, so the first halves' order decides,
    and the second halves' where the first half is the same.
    """
    best = None
    for m in range(STATES):
        first, second = a[:, :, m, None], b[:, m, None, :]
        way = (first // STATES + second // STATES) * STATES**2 + first % STATES * STATES + second % STATES
        best = way if best is None else np.minimum(best, way)
    cost, order = best // STATES**2, best % STATES**2
    return pack(cost, np.where(cost < FAR, order, STATES**2 + np.arange(STATES)))


def meet(a, b, before, after):
    """The state in which two runs meet on the audit-least of the cheapest ways from `before` to `after`."""
    n = np.arange(len(a))
    forward, backward = a[n, before], b[n, :, after]
    return ((forward // STATES + backward // STATES) * STATES + forward % STATES).argmin(axis=1)


def starts_of(owner):
    new = np.ones(len(owner), dtype=bool)
    new[1:] = owner[1:] != owner[:-1]
    return np.flatnonzero(new)


def tree(tables, owner):
    """Levels of (tables, left child of each, whether it has a right one), from the leaves up to one table per owner."""
    levels = [(tables, None, None)]
    while len(starts_of(owner)) < len(owner):
        first = starts_of(owner)
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        left = np.flatnonzero(place % 2 == 0)
        paired = np.append(owner[1:] == owner[:-1], False)[left]
        up = tables[left]
        up[paired] = joined(tables[left[paired]], tables[left[paired] + 1])
        tables, owner = up, owner[left]
        levels.append((tables, left, paired))
    return levels


def descend(levels, before, after):
    """States before and after every leaf, from those of the owners."""
    for (tables, _, _), (_, left, paired) in zip(levels[-2::-1], levels[:0:-1]):
        mine_before, mine_after = np.zeros(len(tables), dtype=np.int64), np.zeros(len(tables), dtype=np.int64)
        mine_before[left], mine_after[left] = before, after
        a = left[paired]
        middle = meet(tables[a], tables[a + 1], before[paired], after[paired])
        mine_after[a], mine_before[a + 1], mine_after[a + 1] = middle, middle, after[paired]
        before, after = mine_before, mine_after
    return before, after


def _numbers(table, name):
    return table.column(name).to_numpy()


def _owners(table, names):
    """Number of each row's group of equal neighbouring keys."""
    new = np.zeros(table.num_rows, dtype=np.int64)
    for name in names:
        v = _numbers(table, name)
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _summaries(batches):
    """One table per piece of a conversation, its first and last initial and its illegal neighbours."""
    for t in whole_tiles(batches, ["__part", "conv"]):
        owner, initial, copies = _owners(t, ["__part", "conv"]), _numbers(t, "initial"), _numbers(t, "copies")
        first = starts_of(owner)
        last = np.append(first[1:], len(owner)) - 1
        pairs = set(LEGAL)
        bad = np.zeros(len(owner), dtype=np.int64)
        bad[1:] = [p not in pairs for p in zip(initial[:-1], initial[1:])]
        bad[first] = 0
        top = tree(row_tables()[_numbers(t, "kind")], owner)[-1][0].reshape(len(first), -1)
        flat = pa.ListArray.from_arrays(np.arange(len(first) + 1, dtype=np.int32) * STATES**2, pa.array(top.ravel()))
        yield pa.RecordBatch.from_arrays(
            [t.column("__part").take(pa.array(first)).combine_chunks(), t.column("conv").take(pa.array(first)).combine_chunks(), flat,
             pa.array(initial[first]), pa.array(initial[last]), pa.array(np.add.reduceat(bad + copies - 1, first))],
            ["__part", "conv", "ways", "first", "last", "illegal"],
        )


def _borders(batches):
    """States before and after each piece, the rows inserted at a conversation's end, and the illegal pairs with the border's."""
    for t in whole_tiles(batches, ["conv"]):
        owner = _owners(t, ["conv"])
        ways = t.column("ways").combine_chunks().flatten().to_numpy().reshape(-1, STATES, STATES)
        first = starts_of(owner)
        levels = tree(ways, owner)
        ends = levels[-1][0][:, 0]
        total = (ends // STATES + np.array([INSERT * len(x) for x in TAILS])) * STATES + ends % STATES
        after = total.argmin(axis=1)
        before, after = descend(levels, np.zeros(len(first), dtype=np.int64), after)
        final = np.append(owner[1:] != owner[:-1], True)
        tails = [TAILS[s] if last else "" for s, last in zip(after, final)]
        bad = _numbers(t, "illegal").copy()
        for i in np.flatnonzero(np.append(False, owner[1:] == owner[:-1])):
            bad[i] += (int(_numbers(t, "last")[i - 1]), int(_numbers(t, "first")[i])) not in LEGAL
        yield pa.RecordBatch.from_arrays(
            [t.column("__part").combine_chunks(), t.column("conv").combine_chunks(), pa.array(before), pa.array(after), pa.array(tails), pa.array(bad)],
            ["__part", "conv", "before", "after", "tail", "illegal"],
        )


def _edits(batches):
    """What happens to each row, without its text; a piece's first row here is its header with the states around it."""
    steps = [row_edits(kind) for kind in range(FORCED + 1)]
    for t in whole_tiles(batches, ["__part", "conv"]):
        head = _numbers(t, "head")
        owner = _owners(t, ["__part", "conv"])[~head]
        body = t.filter(pa.array(~head))
        kind = _numbers(body, "kind")
        tops = [c.astype(np.int64) for c in (_numbers(t, "before")[head], _numbers(t, "after")[head])]
        before, after = descend(tree(row_tables()[kind], owner), *tops)
        found = [steps[k][s, e] for k, s, e in zip(kind.tolist(), before.tolist(), after.tolist())]
        final = np.append(owner[1:] != owner[:-1], True)
        tails = np.where(final, np.array(t.column("tail").to_pylist(), dtype=object)[head][owner], "")
        columns = [body.column(c).combine_chunks() for c in ("conv", "__at")]
        columns += [pa.array([f[i] for f in found], pa.int64() if i == 0 else pa.string()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(tails.tolist(), pa.string())], EDITED)


EDITED = ["conv", "__at", "cost", "edits", "lead", "to", "tail"]
EDITED_TYPES = "conv string, __at bigint, cost bigint, edits string, lead string, to string, tail string"


def conversation_key(conv_id):
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def sorted_rows(turns):
    """Rows by conversation, turn (null first), role and text in range partitions; equal rows are one row with a count.

    Equal rows meet before anything is shuffled. Adds __at (place), __part, and what the
    steps without texts need: a hash of role and text, whether the text is blank or truncated, the role's initial.
    """
    blank = lambda c: F.coalesce(c, F.lit(" "))
    rows = turns.select(
        "conv_id", conversation_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"),
    ).groupBy("conv_id", "conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    letter = F.left("role", F.lit(1))
    initial = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in INITIALS[:-1]]), letter), F.lit(0)) - 1, F.lit(len(INITIALS) - 1))
    # Range borders pass the driver, so they hold the beginnings of texts only, in the same order.
    short = F.when(F.length("role") < 64, F.left("text", F.lit(64))).otherwise("")
    dealt = rows.repartitionByRange("conv", "turn", F.left("role", F.lit(64)), short).sortWithinPartitions("conv", "turn", "role", "text")
    return stored(dealt.select(
        "*", F.monotonically_increasing_id().alias("__at"), F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("same"),
        (bare == "").alias("blank"), (~F.contains(F.lit(".!?"), F.right(bare, F.lit(1)))).alias("open"), initial.cast("int").alias("initial"),
    ).withColumn("__part", F.shiftright("__at", 33)))


def faults_of(rows):
    """(conv, __part, __at, initial, copies, fault, kind) of the rows: the first fault of each and its kind, without texts.

    A duplicate is a row behind the first of its conversation with the same role and text,
    which is found by an aggregation that starts before the shuffle.
    """
    light = rows.select("conv", "__part", "__at", "initial", "copies", "same", "blank", "open")
    firsts = light.groupBy("conv", "same").agg(F.min("__at").alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("__at"), "duplicate").when(F.col("open"), "truncated")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), FORCED).otherwise(2 * F.col("initial") + (F.coalesce("fault", F.lit("")) == "truncated").cast("int"))
    return stored(light.join(firsts, ["conv", "same"]).select("conv", "__part", "__at", "initial", "copies", fault.alias("fault")).withColumn("kind", kind.cast("int")))


def borders(faults):
    """States around each piece (__part, conv) of the conversations."""
    pieces = faults.repartition("__part", "conv").sortWithinPartitions("__part", "conv", "__at").mapInArrow(
        _summaries, "__part bigint, conv string, ways array<bigint>, first int, last int, illegal bigint"
    )
    return pieces.repartition("conv").sortWithinPartitions("conv", "__part").mapInArrow(
        _borders, "__part bigint, conv string, before bigint, after bigint, tail string, illegal bigint"
    )


def edit(faults, ends):
    """Each row's edits: (conv, __at, cost, edits, lead, to, tail).

    lead and tail are the initials of rows inserted before and (at the very end) after it, `to` its new role's.
    """
    fill = lambda c, kind, value=None: F.lit(value).cast(kind).alias(c)
    body = faults.select(
        "__part", "conv", F.lit(False).alias("head"), "__at", "kind", fill("before", "bigint", 0), fill("after", "bigint", 0), fill("tail", "string", ""),
    )
    heads = ends.select(
        "__part", "conv", F.lit(True).alias("head"), fill("__at", "bigint", -1), fill("kind", "int", 0), "before", "after", "tail",
    )
    both = body.unionByName(heads).repartition("__part", "conv").sortWithinPartitions("__part", "conv", F.desc("head"), "__at")
    return both.mapInArrow(_edits, EDITED_TYPES)


def repair(turns):
    """Every conversation's repair: (conv_id, faults, cost, audit, repaired) of rows (conv_id, turn, role, text).

    Null roles and texts are one space; null conv_ids are one conversation; rows of the same turn are ordered by role and
    text, equal rows are adjacent; an empty table gives no rows; other columns do not matter.
    repaired is the rows as an array in order. A conversation is one row of the result, so its
    texts are held in one place by its nature; up to there it is spread over the range
    partitions. Texts are shuffled three times (equal rows, sorting, result), all else is without them.
    """
    rows = sorted_rows(turns)
    faults = faults_of(rows)
    ends = stored(borders(faults))
    # One grouping gathers texts, faults, edits and borders; each row sets its own columns only.
    shapes = {
        "row": rows.select("conv", F.struct("__at", "conv_id", "turn", "role", "text", "copies").alias("x")),
        "fault": faults.select("conv", F.struct("__at", "fault").alias("x")),
        "step": edit(faults, ends).select("conv", F.struct("__at", "cost", "edits", "lead", "to", "tail").alias("x")),
        "illegal": ends.select("conv", F.col("illegal").alias("x")),
    }
    kinds = {name: df.schema["x"].dataType.simpleString() for name, df in shapes.items()}
    sides = [df.select("conv", *[(F.col("x") if n == name else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()]) for name, df in shapes.items()]
    gathered = functools.reduce(lambda a, b: a.unionByName(b), sides).groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), *[F.sort_array(F.collect_list(n)).alias(f"{n}s") for n in ("row", "fault", "step")]
    )
    pieces = F.zip_with("rows", F.zip_with("faults", "steps", lambda f, e: F.struct(f["fault"].alias("fault"), e.alias("e"))), _piece)
    solved = gathered.select("illegal", "rows", F.inline(F.array(F.struct(pieces.alias("pieces")))))
    total = lambda value: F.aggregate(F.transform("pieces", value), F.lit(0).cast("bigint"), lambda a, b: a + b)
    turns_ = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    span = F.try_subtract(F.array_max(turns_), F.array_min(turns_))
    count = lambda name, n: total(lambda p: F.when(F.coalesce(p["fault"] == name, F.lit(False)), n(p)).otherwise(0).cast("bigint"))
    later = total(lambda p: F.when(F.coalesce(p["fault"].isin("blank", "duplicate"), F.lit(False)), 0).otherwise(p["copies"] - 1).cast("bigint"))
    return solved.select(
        F.col("rows")[0]["conv_id"].alias("conv_id"), F.coalesce(span + 1 - F.size(F.array_distinct(turns_)), F.lit(0)).alias("gaps"),
        count("blank", lambda p: p["copies"]).alias("blank"), (count("duplicate", lambda p: p["copies"]) + later).alias("duplicate"),
        count("truncated", lambda p: F.lit(1)).alias("truncated"), "illegal", total(lambda p: p["cost"]).alias("cost"),
        F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"),
        F.flatten(F.transform("pieces", lambda p: p["rows"])).alias("repaired"),
    )


def _piece(row, found):
    """What one row of the input (and its equals) adds to the audit, the cost and the repaired rows."""
    step, extra = found["e"], row["copies"] - 1
    inserted = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.concat(
        F.when(x == "u", NAMES["u"]).otherwise(NAMES["a"]), F.lit(":")
    ))
    role = F.when(step["to"] == "u", NAMES["u"]).when(step["to"] == "a", NAMES["a"]).otherwise(row["role"])
    own = F.when(F.endswith(step["edits"], F.lit("D")), F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), row["text"])))
    return F.struct(
        found["fault"].alias("fault"), row["copies"].alias("copies"),
        (step["cost"] + DELETE * extra + INSERT * F.length(step["tail"])).cast("bigint").alias("cost"),
        F.concat(step["edits"], F.repeat(F.lit("D"), extra.cast("int")), F.regexp_replace(step["tail"], ".", "I")).alias("audit"),
        F.concat(inserted(step["lead"]), own, inserted(step["tail"])).alias("rows"),
    )


def damage(turns):
    """The rows with faults put in, by crc32 of `conv_id:turn` modulo 20; nulls become one space."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    key = F.concat(conversation_key(F.col("conv_id")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(F.encode(key, "UTF-8")) % 20
    hurt = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("f")).where("f <> 0")
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("f") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("f") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def digest(turns):
    """Damaged conversations repaired, one row for each original conv_id; one without rows left has zeros and empty texts."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    fixed = repair(damage(turns)).select(
        conversation_key(F.col("conv_id")).alias("conv"), *counts, "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("hash")
    )
    whole = turns.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    return whole.join(fixed, "conv", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
