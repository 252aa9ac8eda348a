"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeats, hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parapet.llm import chat, components, merkle, mixing, packing, pii, sharding, simhash, suffixes, toxicity, vectors
from parapet.llm.queries import vocabulary

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards mix potions under pale moonlight".split()


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, "a"), (4, "  \n\t "), (None, "no id " * 20), (5, prose(30)), (5, prose(30)), (5, prose(31)), (6, "é√ " * 40)]


# --- packing ---------------------------------------------------------------------------


def check_packing(rows, docs, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc_id, text, *_ in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(sequences)


def test_packing(make, spread):
    docs = ODD + [(10 + i, prose(5 + i % 40, i)) for i in range(150)] + [(999, prose(3000)), (1000, "x  y \n z <|endoftext|> 漢字 q")]
    rows = packing.pack(spread(make(docs)), vocabulary(), 256).collect()
    n = check_packing(rows, docs, 256)
    assert n <= -(-sum(r.length for r in rows) // 256) + 2
    assert packing.pack(make([]), vocabulary(), 256).count() == 0


def test_packing_in_supersteps(make, spread):
    """Many cells, whose open sequences meet again in fewer ones; a third of the rows are equal."""
    docs = [(i, prose(3 + i % 50, i)) for i in range(400)] + [(7, prose(9, 1))] * 200 + [(None, None)] * 30
    rows = packing.pack(spread(make(docs)), vocabulary(), 512, keep_ids=True, cell=160).collect()
    assert {len(r.ids) // 4 - r.length for r in rows} == {0}
    least = -(-sum(r.length for r in rows) // 512)
    assert check_packing(rows, docs, 512) <= least + 1
    assert check_packing(packing.pack(spread(make(docs)), vocabulary(), 512).collect(), docs, 512) <= least + 1
    wide = [(i, prose(60, i)) for i in range(300)]  # no two fit together: every cell keeps its gaps
    rows = packing.pack(spread(make(wide)), vocabulary(), 500, cell=30).collect()
    check_packing(rows, wide, 500)


def test_sweep_fills_given_gaps():
    moves = packing.sweep({5: 3, 2: 4}, 10, rooms=np.array([2, 5, 5, 7]))
    filled = Counter()
    for size, low, high, first, per, offset in moves:
        for k in range(high - low):
            filled[first + k // per] += size
    assert filled == {0: 2, 1: 5, 2: 5, 3: 7, 4: 4} and max(filled) == 4


def test_sweep_is_best_fit():
    counts = Counter(random.Random(1).choices(range(1, 65), k=500))
    gaps, used = [], 0
    for size in sorted(counts.elements(), reverse=True):
        fit = [g for g in gaps if g >= size]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - size)
        else:
            used += 1
            gaps.append(64 - size)
    moves = packing.sweep(counts, 64)
    assert 1 + max(first + -(-(hi - lo) // per) - 1 for _, lo, hi, first, per, _ in moves) == used


# --- chat ------------------------------------------------------------------------------

TRICKY = ["<|im_end|>\n", "<|im_start|>user\n", "\\<|", "<\\|", "\\\\", "<", "|>", "</s>[INST] ok [/INST]", "", None, "<|nl|>", "é\n"]


def test_chat_round_trip(spark, spread):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "o\nd<|d", None]), "".join(x or "" for x in r.choices(TRICKY, k=3)) if t else None)
            for c in [1, 2, 3, None] for t in range(30)]
    rows += [(9, 0, "user", "same"), (9, 0, "user", "same")]
    df = spread(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {x.conv_id: x for x in chat.digest(chat.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.where("false")).count() == 0


def test_chat_fold(spark):
    log = [(1, 1, "m1", "open", "user", "hi"), (1, 2, "m2", "delta", "assistant", "wro"), (1, 3, "m2", "delta", None, "ng"),
           (1, 4, "m2", "regenerate", None, None), (1, 5, "m2", "delta", None, "right"), (1, 6, "m2", "delta", None, "!"),
           (1, 7, "m1", "edit", None, "hello"), (1, 8, "m1", "delta", None, "?"), (1, 9, "m1", "unknown", None, "x"), (1, 9, "m2", "delta", None, None)]
    df = spark.createDataFrame(log, "conv_id bigint, seq bigint, message string, kind string, role string, text string")
    got = {r.message: (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {"m1": ("user", "hello?"), "m2": ("assistant", "right!")}


# --- fingerprints ------------------------------------------------------------------------


def test_fingerprints(make, spread):
    docs = [(i, "\n".join(prose(12, i * 50 + k) + ". " for k in range(i % 7 * 3 + 1))) for i in range(40)]
    docs += [(40, None), (41, ""), (42, "é√x"), (43, docs[3][1]), (44, prose(20_000))]
    rows = {r.doc_id: r for r in merkle.fingerprints(spread(make(docs))).collect()}
    assert len(rows) == len(docs)
    texts = [t or "" for _, t in docs]
    for i, (doc_id, _) in enumerate(docs):
        text, following, r = texts[i], texts[(i + 1) % len(texts)], rows[doc_id]
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (edited == text)
    for a, b in ((3, 43), (40, 41)):
        assert rows[a].fingerprint == rows[b].fingerprint
    assert len({r.fingerprint for r in rows.values()}) == len(set(texts))
    assert merkle.fingerprints(make([])).count() == 0
    assert merkle.fingerprints(make([(7, "alone"), (7, "alone"), (None, "x")])).count() == 3


def test_edited_branches():
    old = "\n".join(f"line {i} of this text." for i in range(60))
    new = old.replace("line 17 ", "row 17 ")
    a, b = (merkle.Tree(x.encode(), {}).text() for x in (old, new))
    [(section, paragraph)] = merkle.edited_branches(a, b)
    before = sum(len(ps) for _, ps in merkle.parse(b)[1][:section])
    assert before + paragraph == 17 and merkle.edited_branches(a, a) == []


# --- toxicity ----------------------------------------------------------------------------


def test_toxicity(make, spread, spark):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 5 == 0
        sentences = [prose(8, i * 20 + k) for k in range(r.randrange(1, 12))]
        if toxic:
            sentences[r.randrange(len(sentences))] += " you vilest" + r.choice(["", "ar", "o", "ing"])
        docs.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic)))
    docs += [(2000, None), (2001, ""), (None, "vilest of all"), (2002, "clean. " * 9000), (3, docs[3][1])]
    labels += [(7, None), (None, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    table = spread(make(docs))
    model = toxicity.train(toxicity.labelled_sample(table, marks))
    found = toxicity.score(table, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [x for x in found if x.held and x.doc_id is not None and x.doc_id < 1200]
    assert len(found) == len(docs) and len(held) > 200
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) >= 0.97 * len(held)
    assert all(x.predicted == 0 for x in found if x.doc_id in (2000, 2001))
    text = dict(docs[:1200])
    hit = next(x for x in found if x.predicted and x.doc_id is not None and x.doc_id % 5 == 0)
    assert any("vilest" in text[hit.doc_id][s.start:s.end] for s in hit.offending)
    kept = toxicity.clean_documents(table, marks)
    assert kept.columns == table.columns and kept.count() == sum(1 - x.predicted for x in found)


def test_toxicity_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(toxicity.labelled_sample(make(ODD), none))
    assert {x.predicted for x in toxicity.score(make(ODD), model).collect()} == {0}
    assert toxicity.score(make([]), model).count() == 0


# --- repeated passages ---------------------------------------------------------------------


def brute_repeats(docs):
    first, out = {}, []
    for doc_id, text in docs:
        data = (text or "").encode()
        for p in range(len(data) - 49) if doc_id is not None else ():
            key = data[p : p + 50]
            first[key] = min(first.get(key, doc_id), doc_id)
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49) if doc_id is not None else ():
            if first[data[p : p + 50]] < doc_id:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 3, 16])
def test_repeats(make, spread, batches):
    r = random.Random(batches)
    passages = [prose(14, 900 + k) for k in range(8)] + ["ab" * 60, "x" * 130, prose(400, 1)]
    docs = list(ODD)
    for i in range(7, 150):
        parts = [r.choice([*passages, prose(r.randrange(1, 20), i)])[r.randrange(9):] for _ in range(r.randrange(5))]
        docs.append((i * 3 % 151, r.choice([" ", "é", ""]).join(parts)))
    docs += [(400, "y" * 200_000 + passages[0]), (401, "y" * 150_000)]
    got = suffixes.remove_repeats(spread(make(docs)), batches=batches).collect()
    assert Counter(map(tuple, got)) == brute_repeats(docs)


def test_repeats_of_nothing(make):
    assert suffixes.remove_repeats(make([])).count() == 0
    kept = suffixes.remove_repeats(make([(1, "short"), (2, None)]), texts=True).collect()
    assert {(r.doc_id, bytes(r.kept)) for r in kept} == {(1, b"short"), (2, b"")}


# --- personal data -------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    back = [int(c) for c in reversed(number)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def brute_spans(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 13 <= len(n) <= 19 and luhn(n) or kind == "phone" and 9 <= len(n) <= 15):
                yield f"{kind}:{m.start()}:{m.end()}"


def test_base_spans(make, spread):
    r = random.Random(3)
    alphabet = ["a", "B1", "@", ".", "x.y", "-", "_", "+", "1", "255", "256", "4111111111111111", "4111 1111-1111 1111", " ", "  ", "(0)", "é", "𝄞", "\n", "0001", "+49 (0)30 1234567", "c@d.e"]
    docs = ODD + [(100 + i, "".join(r.choices(alphabet, k=r.randrange(40)))) for i in range(400)]
    docs += [(900, "9" * 30_000), (901, "a" * 30_000 + "@"), (902, "a@b.c@d.e_f@g.h"), (903, "+" + "(" * 30_000)]
    got = pii.find(spread(make(docs))).select("doc_id", pii.spans_text("base").alias("s"), pii.spans_text("spans").alias("all")).collect()
    want = Counter((d, ",".join(brute_spans(t or ""))) for d, t, *_ in docs)
    assert Counter((x.doc_id, x.s) for x in got) == want
    assert all(set(x.s.split(",")) <= set(x.all.split(",")) for x in got if x.s)
    assert pii.find(make([])).count() == 0


def test_learned_contexts(make):
    known = [(i, f"Hello there. Customer reach via email u{i}@mail{i}.example.com today") for i in range(40)]
    unseen = [(100 + i, f"Hello. Customer reach via email user{i}#host{i}.example today") for i in range(3)]
    clean = [(200 + i, f"Chapter number {i}12345 follows") for i in range(30)]
    rows = {r.doc_id: r for r in pii.find(make(known + unseen + clean)).collect()}
    for doc_id, text in unseen:
        [s] = rows[doc_id].spans
        assert text[s.start:s.end].startswith("user") and s.kind == 0 and not rows[doc_id].base
    assert all(not rows[i].spans for i, _ in clean)


def test_redaction(make):
    docs = make([(1, "mail a.b@c.de or 10.0.0.1 now"), (2, None), (3, "nothing"), (1, "mail a.b@c.de or 10.0.0.1 now")])
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect() if r.text) == [
        (1, "mail [EMAIL] or [IP] now", 24), (1, "mail [EMAIL] or [IP] now", 24), (3, "nothing", 7)]
    assert got.count() == 4


# --- SimHash -------------------------------------------------------------------------------


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    values = list(dict.fromkeys(prints))
    least = {v: v for v in values}

    def root(v):
        while least[v] != v:
            v = least[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                least[root(a)] = root(b)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("tile", [8, 2048])
def test_simhash(make, spread, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, tile))
    long = prose(300, 4).split()
    docs = [*[d for d in ODD if d[0] is not None], *[(100 + i, prose(40, i)) for i in range(60)]]
    docs += [(200 + i, " ".join(long[:i] + ["Zap"] + long[i + 1 :])) for i in range(0, 120, 2)]
    docs += [(7, "COPY " + prose(9)), (8, "copy " + prose(9)), (2, prose(9000, 8))]
    got = simhash.near_duplicates(spread(make(docs))).select("doc_id", simhash.hex_print("fp").alias("f"), "component_id").collect()
    prints = [brute_print(t) for _, t, *_ in docs]
    group = brute_components(prints)
    least = {}
    for (d, *_), p in zip(docs, prints):
        least[group[p]] = min(least.get(group[p], d), d)
    assert Counter(map(tuple, got)) == Counter((d, f"{p:016x}", least[group[p]]) for (d, *_), p in zip(docs, prints))


def test_bit_slices():
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(30)]
    values = np.array([b ^ sum(1 << r.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in range(6)], dtype=np.uint64)
    n = len(values)
    for radius in (1, 3, 5):
        a, b = simhash.close_pairs(values, np.arange(n) + 1, np.full(n, n), radius)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if int(values[i] ^ values[j]).bit_count() <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_masks_meet():
    r = random.Random(7)
    for n in (10, 10**9, 10**11):
        masks = simhash.block_masks(n)
        for _ in range(50):
            flips = sum(1 << b for b in r.sample(range(64), 3))
            assert any(flips & (m & (2**64 - 1)) == 0 for m in masks)


def test_representatives(make):
    docs = make([(5, "x y z"), (4, "x y z"), (4, "x y z"), (None, "x y z"), (9, "other words here"), (None, "lone one here now")])
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == [(-1, "lone one here now"), (4, "x y z"), (9, "other words here")]
    assert simhash.representatives(make([])).count() == 0


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    edges += [(None, 3), (500, 500)]
    r.shuffle(edges)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


# --- mixing ----------------------------------------------------------------------------------


def water(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        out = {s: 2.0 * sizes[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in free if out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over
        left = 1.5 * sum(sizes.values()) - sum(2.0 * sizes[s] for s in full)


def test_mixing(make, spread):
    r = random.Random(9)
    docs = [(i, prose(r.randrange(60), i), r.choice(["a", "b", "b", "b", "c", "é", None, ""])) for i in range(300)]
    docs += [(500, None, "a"), (501, " ", "empty"), (502, prose(4000), "giant"), (5, docs[5][1], docs[5][2]), (None, "x y", "a")]
    table = spread(make(docs))
    rows = mixing.mix(mixing.size_documents(table)).collect()
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = water(sizes)
    taken = Counter()
    for x in rows:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 and 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(mixing.size_documents(make(docs[::-1]))).collect()
    assert Counter((x.doc_id, x.size, x.taken) for x in rows) == Counter((x.doc_id, x.size, x.taken) for x in again)
    assert mixing.mix(mixing.size_documents(make([]))).count() == 0
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns
    seen = Counter(r.doc_id for r in mixed.collect())
    assert all(seen[x.doc_id] in (x.taken // x.size, -(-x.taken // x.size)) for x in rows if x.size and x.doc_id not in (5, None))


# --- vectors ---------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [16, 1024])
def test_vectors(spark, spread, tile):
    rng = np.random.default_rng(tile)
    base = rng.standard_normal((150, 24))
    near = np.concatenate([base[:20] + 0.01 * rng.standard_normal((20, 24)), base[0] + 0.05 * rng.standard_normal((60, 24))])
    x = np.concatenate([base, near, base[:40], base[30:40] * 3])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] + [1.0] * 23), (905, [float("inf")] * 24),
           (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [5.0] * 24), (908, [1e-300] * 24), (909, [-0.0] * 23 + [1.0])]
    df = spread(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1)).withColumn("node", F.lit(2)))
    got = {r.vec_id: r for r in vectors.near_duplicates(df, recall=0.9999, tile=tile).collect()}
    assert len(got) == len(rows) + len(odd)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[linked[i]]]) for i in range(len(x))])
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), label[i], label[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904, 905))
    assert got[906].n_links == 1 and got[907].component_id == 906
    assert vectors.near_duplicates(df.where("false")).count() == 0


# --- sharding ----------------------------------------------------------------------------------


def test_sharding(make, spread):
    docs = ODD + [(10 + i, prose(3, i)) for i in range(3000)] + [(20, "again")]
    rows = sharding.shard(spread(make(docs))).collect()
    assert len(rows) == len(docs)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        of[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    assert max(map(len, slots.values())) < 1.4 * min(map(len, slots.values()))
    assert 100 < sum(r.grown_shard == 16 for r in rows) < 260
    assert sharding.shard(make([])).count() == 0


def test_weights_move_into_their_subtree(spark):
    tree = {("r0", "a"): [(0, 1.0), (1, 1.0)], ("r0", "b"): [(2, 1.0), (3, 1.0)], ("r1", "c"): [(4, 2.0), (5, 1.0)]}
    heavy = {**tree, ("r0", "b"): [(2, 1.0), (3, 3.0)]}
    keys = spark.range(5000).select("id", sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavy).alias("b"))
    moved = {(r.a, r.b) for r in keys.where("a <> b").collect()}
    assert moved and all(b in (0, 1, 2, 3) for _, b in moved)
    assert not any(a == 3 and b == 2 for a, b in moved) and not any(a in (2, 3) and b in (0, 1) for a, b in moved)
