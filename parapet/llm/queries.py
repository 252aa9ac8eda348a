"""The registered queries of the training-data operators: production parameters, whole tables."""

from pyspark.sql import functions as F

from parapet.llm import chat, merkle, mixing, packing, pii, quality, repair, sharding, simhash, spelling, suffixes, toxicity, vectors
from parapet.llm.common import table

REGISTRY = {}

TRICKY = "</s>[INST] ok [/INST]"


def query(sql=None):
    def add(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return add


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_pack(spark, folder):
    """Best-fit packing of all documents into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), vocabulary())


@query("""
    WITH turns AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), marked AS (
      SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS safe FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
           CAST(sum(length('<|im_start|>') + length(role) + 1 + length(safe) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id
""")
def op2_chat(spark, folder):
    """All conversations formatted, and one whose texts are control strings; read back from the output."""
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    rows = [F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"),
                     F.lit(role).alias("role"), F.lit(TRICKY).alias("text")) for i, role in enumerate(("user", "assistant"))]
    tricky = spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
    return chat.digest(chat.format_conversations(turns.unionByName(tricky)))


@query()
def op3_fingerprint(spark, folder):
    """Merkle fingerprints of all documents and of their edited texts."""
    return merkle.fingerprints(table(spark, folder, "documents"))


@query()
def op4_toxicity(spark, folder):
    """Toxicity scores of all documents; three quarters of the labels may be learned from."""
    docs = table(spark, folder, "documents")
    model = toxicity.train(toxicity.labelled_sample(docs, table(spark, folder, "labels")))
    scored = toxicity.score(docs, model).withColumn("n_offending", F.size("offending").cast("bigint"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_offending")


@query()
def op5_suffixes(spark, folder):
    """All documents without the 50-byte strings that an earlier one has."""
    return suffixes.remove_repeats(table(spark, folder, "documents"))


@query()
def op6_pii(spark, folder):
    """Personal data of all documents: counts and hash of the base spans, and all spans."""
    found = pii.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id", *[pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.spans_text("base"), 256).alias("base_sha256"), pii.spans_text("spans").alias("spans"),
    )


@query()
def op7_simhash(spark, folder):
    """SimHash fingerprints of all documents and the components of their links."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


@query()
def op8_mix(spark, folder):
    """All documents mixed to the target weights."""
    taken = mixing.mix(mixing.size_documents(table(spark, folder, "documents")))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query("""
    WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
    ), links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= 0.95
    ), reach(a, b) AS (
      SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
    ), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id,
           e.vec_id = least(e.vec_id, coalesce(m.b, e.vec_id)) AS kept
    FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least m ON m.a = e.vec_id
""")
def op9_vectors(spark, folder):
    """Links, components and kept rows of all embeddings."""
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query()
def op10_shard(spark, folder):
    """All documents put into shards 0 to 15, and where they were with one more."""
    return sharding.shard(table(spark, folder, "documents"))


@query(r"""
    WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (
      SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs)
    ), counts AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY k),
    grams AS (
      SELECT k, i, string_agg(w, ' ') OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram,
             count(*) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS size FROM words
    ), again AS (
      SELECT k, i FROM grams WHERE size = 8 QUALIFY count(*) OVER (PARTITION BY k, gram) > 1
    ), repeated AS (
      SELECT k, sum(d) AS n_repeat_words
      FROM (SELECT k, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS d FROM again) GROUP BY k
    ), lines AS (
      SELECT k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, lower(line) AS low,
             right(rtrim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '"''”’»)]'), 1) AS last
      FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs)
    ), judged AS (
      SELECT *, CASE
        WHEN words = 0 THEN NULL
        WHEN words <= 30 AND (contains(low, 'all rights reserved') OR contains(low, 'licensed under')
          OR contains(low, 'released under the') OR contains(low, 'cookie') OR contains(low, 'privacy policy')
          OR contains(low, 'terms of use') OR contains(low, 'terms of service') OR contains(low, 'javascript')
          OR contains(low, 'copyright') OR contains(low, '©') OR contains(low, 'lorem ipsum') OR contains(low, 'subscribe to'))
          THEN 'boilerplate'
        WHEN (len(regexp_extract_all(line, '[|»›•·>]')) >= 2 AND 4 * len(regexp_extract_all(line, '[|»›•·>]')) >= words)
          OR regexp_matches(line, '(?i)^[ \t]*(home|next|previous|back to top|skip to (main )?content|read more|click here|menu|search|log ?in|sign (in|up)|share this|page [0-9]+( of [0-9]+)?)[ \t.!:»>]*$')
          THEN 'navigation'
        WHEN last = '' OR NOT contains('.!?…。！？', last) OR 3 * len(regexp_extract_all(line, '[#*$%&|<>]')) >= words
          OR 3 * len(regexp_extract_all(line, '[!?][!?]')) >= words THEN 'punctuation'
      END AS fault FROM lines
    ), per_doc AS (
      SELECT k, count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS n_dup_lines,
             count(*) FILTER (fault = 'boilerplate') AS n_boilerplate_lines, count(*) FILTER (fault = 'navigation') AS n_navigation_lines,
             count(*) FILTER (fault = 'punctuation') AS n_punctuation_lines, coalesce(sum(words) FILTER (fault IS NOT NULL), 0) AS n_lost_words
      FROM judged GROUP BY k
    ), base AS (
      SELECT d.doc_id, coalesce(c.n_words, 0) AS n_words, CAST(coalesce(c.word_chars, 0) AS BIGINT) AS word_chars,
             len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, p.n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             p.n_boilerplate_lines, p.n_navigation_lines, p.n_punctuation_lines, CAST(p.n_lost_words AS BIGINT) AS n_lost_words
      FROM docs d JOIN per_doc p USING (k) LEFT JOIN counts c USING (k) LEFT JOIN repeated r USING (k)
    )
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words < 50 * n_words AS kept
    FROM base
""")
def op11_quality(spark, folder):
    """Base figures of all documents, and which are kept after line-first cleaning."""
    return quality.judge(table(spark, folder, "documents")).drop("cleaned")


CRC_TABLE = """
    crc_table AS (
      SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
               lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
    )"""


def crc_sql(points):
    """crc32 of a list of byte values in SQL; `steps` is the column of CRC_TABLE."""
    return (
        f"xor(list_reduce(list_concat([4294967295], {points}), "
        "lambda c, b: xor(c >> 8, steps[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)"
    )


@query(rf"""
    WITH RECURSIVE {CRC_TABLE}, hurt AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {crc_sql("list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 20 AS f
      FROM conversations, crc_table
    ), damaged AS (
      SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS time
      FROM hurt WHERE f <> 0
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
    ), rows AS (
      SELECT *, left(role, 1) AS init, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
      FROM placed
    ), priced AS (
      SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS forced, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra,
             CASE WHEN init = 'u' THEN 'K' ELSE 'R' END AS eu, CASE WHEN init = 'a' THEN 'K' ELSE 'R' END AS ea,
             CASE WHEN init = 'u' THEN 0 ELSE 2 END AS pu, CASE WHEN init = 'a' THEN 0 ELSE 2 END AS pa,
             CASE WHEN init = 'u' THEN role ELSE 'user' END || ':' || text AS tu,
             CASE WHEN init = 'a' THEN role ELSE 'assistant' END || ':' || text AS ta
      FROM rows
    ), far AS (SELECT {{'c': 1000000000000, 'a': '~', 'r': CAST([] AS VARCHAR[])}} AS x),
    walk(conv_id, i, s0, s1, s2, s3) AS (
      SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}}, x, x, x FROM conversations, far
      UNION ALL
      SELECT w.conv_id, p.i,
        {{'c': s0.c + 3, 'a': s0.a || 'D', 'r': s0.r}},
        list_min([{{'c': s1.c + 3, 'a': s1.a || 'D', 'r': s1.r}}, CASE WHEN NOT forced AND init = 's'
          THEN {{'c': s0.c + extra, 'a': s0.a || 'K', 'r': list_append(s0.r, role || ':' || text)}} ELSE x END]),
        list_min([{{'c': s2.c + 3, 'a': s2.a || 'D', 'r': s2.r}},
          CASE WHEN forced THEN x ELSE {{'c': s0.c + pu + extra, 'a': s0.a || eu, 'r': list_append(s0.r, tu)}} END,
          CASE WHEN forced THEN x ELSE {{'c': s1.c + pu + extra, 'a': s1.a || eu, 'r': list_append(s1.r, tu)}} END,
          CASE WHEN forced THEN x ELSE {{'c': s3.c + pu + extra, 'a': s3.a || eu, 'r': list_append(s3.r, tu)}} END,
          CASE WHEN forced THEN x ELSE {{'c': s2.c + 2 + pu + extra, 'a': s2.a || 'I' || eu, 'r': list_concat(s2.r, ['assistant:', tu])}} END]),
        list_min([{{'c': s3.c + 3, 'a': s3.a || 'D', 'r': s3.r}},
          CASE WHEN forced THEN x ELSE {{'c': s2.c + pa + extra, 'a': s2.a || ea, 'r': list_append(s2.r, ta)}} END,
          CASE WHEN forced THEN x ELSE {{'c': s0.c + 2 + pa + extra, 'a': s0.a || 'I' || ea, 'r': list_concat(s0.r, ['user:', ta])}} END,
          CASE WHEN forced THEN x ELSE {{'c': s1.c + 2 + pa + extra, 'a': s1.a || 'I' || ea, 'r': list_concat(s1.r, ['user:', ta])}} END,
          CASE WHEN forced THEN x ELSE {{'c': s3.c + 2 + pa + extra, 'a': s3.a || 'I' || ea, 'r': list_concat(s3.r, ['user:', ta])}} END])
      FROM walk w JOIN priced p ON p.conv_id = w.conv_id AND p.i = w.i + 1, far
    ), ended AS (
      SELECT conv_id, list_min([s0, {{'c': s1.c + 4, 'a': s1.a || 'II', 'r': list_concat(s1.r, ['user:', 'assistant:'])}},
                                {{'c': s2.c + 2, 'a': s2.a || 'I', 'r': list_append(s2.r, 'assistant:')}}, s3]) AS best
      FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
    ), counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (prior IS NOT NULL AND prior || init NOT IN ('su', 'ua', 'au')) AS illegal
      FROM rows GROUP BY conv_id
    )
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
           sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
    FROM ended e LEFT JOIN counts c USING (conv_id)
""")
def op12_repair(spark, folder):
    """All conversations damaged by a fixed rule, and their cheapest repairs."""
    return repair.digest(table(spark, folder, "conversations"))


@query(rf"""
    WITH RECURSIVE {CRC_TABLE}, runs AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]{{6,}}')) AS run FROM documents
    ), hashed AS (
      SELECT run, {crc_sql("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) - 64 AS BIGINT)] END))")} AS h
      FROM runs, crc_table
    ), words AS (
      SELECT word, count(*) AS n
      FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed)
      WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
    ), cut AS (
      SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), near AS (
      SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
      UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
    ), best AS (
      SELECT near.word, first(other ORDER BY w.n DESC, other) AS other, max(w.n) AS other_n, count(*) AS n_near
      FROM near JOIN words w ON w.word = near.other GROUP BY near.word
    ), formed AS (
      SELECT w.word, CASE WHEN other_n >= 5 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
      FROM words w LEFT JOIN best USING (word)
    ), follow AS (
      SELECT word, word AS root, 0 AS steps FROM formed
      UNION ALL SELECT f.word, t.form, f.steps + 1 FROM follow f JOIN formed t ON t.word = f.root AND t.form IS NOT NULL
    ), ends AS (SELECT word, arg_max(root, steps) AS root FROM follow GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
""")
def op13_spelling(spark, folder):
    """Frequent words of all documents, their near words and the forms that they are variants of."""
    return spelling.group_variants(table(spark, folder, "documents"))


def queries():
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
