"""Personal data: exact base patterns and bootstrapped contextual extraction, DataFrame functions only."""

from pyspark.sql import functions as F

from parapet.llm.common import fresh, let, stored

# The contract's patterns, in a form that is linear on long runs. A match can
# start only where a run starts or where the match before it ended (\G), since a run that
# fails from its start fails from any later place. Repeated groups never give back, which Java runs without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A token that may be an identifier: it holds a digit, or an @, and has six characters at least.
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]{6})[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

KINDS = ("email", "ip", "card", "phone")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
LEFT_WORDS = 2
TAIL = 120  # code points before a span, on its line, in which its words are looked for
PRIOR = 4.0
TRUST = 0.9  # what an instance without a known kind can reach at most
ACCEPT = 0.7
TOLERANCE = 0.001
SPAN = "struct<kind:int,start:int,end:int,value:string,context:string>"


def digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number):
    """The number's digits pass the Luhn check."""
    backwards = F.split(F.reverse(number), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)
    )
    return F.aggregate(F.transform(backwards, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind, value):
    number = digits(value)
    n = F.length(number)
    if kind == "ip":
        plain = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(
            F.split(value, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255)
        )
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


# What a text must hold before a pattern is worth running.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def _chunks(array):
    """The array in about sqrt(n) pieces of about sqrt(n) elements, so that what grows in a fold stays short."""
    width = F.ceil(F.sqrt(F.size(array))).cast("int")
    return F.when(F.size(array) > 0, F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(array) / width).cast("int") - 1), lambda i: F.slice(array, i * width + 1, width)
    ))


def _before(tail):
    """The last words of the text before a span on its line, in lower case; empty where there are none."""
    return F.lower(F.substring_index(F.rtrim(tail), " ", -LEFT_WORDS))


def _spans(matches, number, check=None):
    """Spans of the matches {gaps, found}: the pieces between matches give the positions (code points) and the words before."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(a, pair):
        start = a["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        tail = F.right(F.substring_index(F.concat(a["tail"], pair["gap"]), "\n", -1), F.lit(TAIL))
        span = F.struct(
            F.lit(number).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"),
            pair["value"].alias("value"), _before(tail).alias("context"),
        )
        tail = F.right(F.concat(tail, pair["value"]), F.lit(TAIL))
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(a["spans"], F.array(span)).alias("spans"))

    def chunk(a, pairs):
        begin = F.struct(a["at"].alias("at"), a["tail"].alias("tail"), none.alias("spans"))
        return F.aggregate(pairs, begin, step, lambda b: F.struct(
            b["at"].alias("at"), b["tail"].alias("tail"), F.concat(a["spans"], F.array(b["spans"])).alias("spans")
        ))

    pairs = F.zip_with(
        F.slice(matches["gaps"], 1, F.size(matches["found"])), matches["found"],
        lambda g, v: F.struct(g.alias("gap"), v.alias("value")),
    )
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<array<{SPAN}>>").alias("spans"))
    spans = let(pairs, lambda p: F.aggregate(_chunks(p), begin, chunk, lambda a: F.flatten(a["spans"])))
    spans = F.filter(spans, lambda s: check(s["value"])) if check else spans
    return F.coalesce(spans, none)


def _matches(text, pattern, guard):
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(guard, F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found")))


def with_base_spans(docs):
    """Adds __base: the spans of the four base kinds, by kind and start; a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("*", *[_matches(text, PATTERNS[k], GUARDS[k](text)).alias(f"__{k}") for k in KINDS])
    each = [
        _spans(F.col(f"__{k}"), i, None if k == "email" else (lambda v, k=k: passes(k, v))) for i, k in enumerate(KINDS)
    ]
    return found.withColumn("__base", F.concat(*each)).drop(*[f"__{k}" for k in KINDS])


def with_candidates(docs):
    """Adds __candidates: tokens that may be identifiers and overlap no base span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("__tokens", _matches(text, CANDIDATE, text.rlike("[0-9@]")))
    meet = lambda b, start, end: (b["start"] < end) & (start < b["end"])

    def free(some):
        """Those of a run of tokens that meet no base span; only base spans near the run are looked at."""
        near = F.filter("__base", lambda b: meet(b, some[0]["start"], F.element_at(some, -1)["end"]))
        return let(near, lambda n: F.filter(some, lambda c: ~F.exists(n, lambda b: meet(b, c["start"], c["end"]))))

    alone = let(_spans(F.col("__tokens"), -1), lambda t: F.flatten(F.transform(_chunks(t), free)))
    return found.withColumn("__candidates", F.coalesce(alone, F.array().cast(f"array<{SPAN}>"))).drop("__tokens")


KIND_NUMBERS = range(len(KINDS))


def _best(columns):
    """The largest of the scores and its kind, the first on ties."""
    first = F.array(*[F.struct(c.alias("score"), F.lit(-i).alias("back")) for i, c in enumerate(columns)])
    return let(F.array_max(first), lambda m: F.struct(m["score"].alias("score"), (-m["back"]).alias("kind")))


def _settled(pairs):
    """Scores p0.. of each context: its instances' scores over all its instances and a prior, at the fixed point.

    An instance of a known kind counts 1; any other at most TRUST, by noisy-or over its
    contexts. The turns start from what each context would reach on its own, which is never
    too much, so scores only rise until none moves by more than TOLERANCE.
    """
    n = F.count(F.lit(1))
    known = lambda i: F.count_if(F.col("kind") == i)
    scores = stored(pairs.groupBy("context").agg(
        *[(known(i) / (n + PRIOR - TRUST * F.count_if(F.col("kind") < 0))).alias(f"p{i}") for i in KIND_NUMBERS]
    ))
    # Only instances of several contexts can raise a score above that.
    unseen = pairs.where("kind < 0")
    shared = unseen.groupBy("value").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    if shared.isEmpty():
        return scores
    while True:
        some = lambda i: (TRUST * (1 - F.exp(F.sum(F.log(1 - F.col(f"p{i}")))))).alias(f"i{i}")
        instances = unseen.join(scores, "context").groupBy("value").agg(*[some(i) for i in KIND_NUMBERS])
        score = lambda i: F.when(F.col("kind") == i, 1.0).when(F.col("kind") >= 0, 0.0).otherwise(F.coalesce(F.col(f"i{i}"), F.lit(0.0)))
        later = pairs.join(instances, "value", "left").groupBy("context").agg(
            *[(F.sum(score(i)) / (n + PRIOR)).alias(f"q{i}") for i in KIND_NUMBERS]
        )
        moved = stored(scores.join(later, "context"))
        scores = moved.select("context", *[F.col(f"q{i}").alias(f"p{i}") for i in KIND_NUMBERS])
        if moved.where(F.greatest(*[F.abs(F.col(f"q{i}") - F.col(f"p{i}")) for i in KIND_NUMBERS]) > TOLERANCE).isEmpty():
            return scores


def learn_patterns(occurrences, accept=ACCEPT):
    """Contexts (with their kind) that announce identifiers with a score of at least `accept`.

    `occurrences`: stored (kind, value, context), kind -1 for candidates. Base spans are the
    seeds. The contexts of all seeds are scored by their distinct instances until the scores
    settle; candidates after an accepted context become seeds of its kind and bring in their
    other contexts, until no new one is found. With s seeds and u others a context of its
    own is accepted if s / (s + PRIOR + (1 - TRUST) * u) reaches `accept`.
    """
    graph = stored(
        occurrences.where(F.col("context") != "").groupBy("context", F.lower("value").alias("value")).agg(F.max("kind").alias("kind"))
    )
    seeds = stored(graph.where("kind >= 0").groupBy("value").agg(F.max("kind").alias("seed")))
    while True:
        known = graph.join(seeds, "value", "left").withColumn("kind", F.coalesce("seed", "kind")).drop("seed")
        seeded = known.where("kind >= 0").select("context").distinct()
        pairs = stored(known.join(seeded, "context", "left_semi"))
        best = _best([F.col(f"p{i}") for i in KIND_NUMBERS])
        patterns = stored(
            _settled(pairs).select("context", best.alias("best")).where(F.col("best.score") >= accept)
            .select("context", F.col("best.kind").alias("kind"), F.col("best.score").alias("score"))
        )
        found = pairs.where("kind < 0").drop("kind").join(patterns, "context").groupBy("value").agg(
            F.max(F.struct("score", "kind"))["kind"].alias("seed")
        )
        found = stored(found)
        if found.isEmpty():
            return patterns
        seeds = stored(seeds.unionByName(found))


def find(docs, keep=("doc_id",)):
    """Kept columns, base and spans (arrays of kind, start, end; code points, end exclusive).

    base: the base kinds, all of them, in order. spans: base and what the learned patterns
    discover, whole tokens after an accepted context. Null and empty texts have no spans;
    repeated rows are found each; a table without seeds learns nothing.
    """
    row = F.monotonically_increasing_id().alias("__row")
    marked = with_candidates(with_base_spans(docs.select("text", *keep)))
    marked = stored(marked.select(row, *keep, "__base", "__candidates"))
    seen = lambda c: marked.select("__row", F.explode(c).alias("s")).select("__row", "s.*")
    candidates = stored(seen("__candidates"))
    patterns = learn_patterns(stored(seen("__base").unionByName(candidates).select("kind", "value", "context")))
    found = (
        candidates.drop("kind").join(patterns, "context")
        .groupBy("__row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("__found"))
    )
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = plain(F.col("__base"))
    return marked.join(stored(found), "__row", "left").select(
        *keep, base.alias("base"),
        F.when(F.col("__found").isNull(), base).otherwise(F.sort_array(F.concat(base, F.col("__found")))).alias("spans"),
    )


def spans_text(spans, kinds=KINDS):
    """kind:start:end, joined with commas."""
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def redacted(docs):
    """Documents whose spans are replaced by their kind in brackets; all columns kept, n_chars recounted.

    Overlapping spans become one, named after the first kind.
    """
    mine, spans = fresh("__key", docs), fresh("__spans", docs)
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    found = find(docs.select("text", key.alias("__key")), ["__key"])
    found = stored(found.where(F.size("spans") > 0).groupBy(F.col("__key").alias(mine)).agg(F.first("spans").alias(spans)))
    joined = docs.withColumn(mine, key).join(found, mine, "left")
    ordered = F.array_sort(F.col(spans), lambda a, b: (a["start"] * 8 + a["kind"] - b["start"] * 8 - b["kind"]).cast("int"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")
    # Each span with the end of those before it; text is cut for a run of spans first, then for each of them.
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def run(a, some):
        last = F.greatest(a["at"], F.array_max(F.transform(some, lambda s: s["end"])))
        piece = F.substr(text, a["at"] + 1, last - a["at"])

        def cut(piece):
            def step(b, s):
                gap = F.substr(piece, b["at"] - a["at"] + 1, F.greatest(s["start"] - b["at"], F.lit(0)))
                mark = F.when(s["start"] >= b["at"], F.get(names, s["kind"])).otherwise("")
                return F.struct(F.greatest(b["at"], s["end"]).alias("at"), F.concat(b["out"], gap, mark).alias("out"))

            inner = F.struct(a["at"].alias("at"), F.lit("").alias("out"))
            return F.aggregate(some, inner, step, lambda b: F.struct(b["at"].alias("at"), F.concat(a["out"], b["out"]).alias("out")))

        return let(piece, cut)

    clean = let(ordered, lambda o: F.aggregate(_chunks(o), begin, run, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1))))
    joined = joined.withColumn("text", F.coalesce(clean, text))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(docs.columns)
