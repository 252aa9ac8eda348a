"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parapet.llm.common import stored, uniform

SAMPLE_ROWS = 20_000
SAMPLE_CHARS = 80_000_000
WORDS = 2_000
LEAST_Z = 5.0
LEAST_DOCS = 3
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[.!?\n]")
BREAKS = frozenset(".!?\n")
STEPS = 400
STEMS = range(4, 9)
REMEMBERED = 200_000


def parts(word):
    """What is learned of a word: itself and its beginnings, so that inflected forms share weights."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


class _Features(dict):
    """Numbers of a word's telling parts, looked up once for each word; emptied when full."""

    def __init__(self, words):
        super().__init__()
        self.index = {w: i for i, w in enumerate(words)}

    def __missing__(self, word):
        found = tuple(self.index[p] for p in parts(word) if p in self.index)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def labelled_sample(docs, labels, rows=SAMPLE_ROWS, chars=SAMPLE_CHARS):
    """At most `rows` labelled documents (text, toxic), chosen by a hash of their ids, none held out,
    of `chars` code points together at most; no text of more than a hundredth of that is learned from.

    A label that is null does not count; of several labels of a document the largest does,
    of several texts of an id the one of least hash.
    """
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("double").alias("toxic"))
        .orderBy(uniform("__id", seed=3), "__id").limit(rows)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(stored(ids)), F.col("doc_id") == F.col("__id"))
    text = F.coalesce("text", F.lit(""))
    # One row per id; hashes meet before the shuffle, texts of equal hash and length are equal.
    single = stored(chosen.where(F.length(text) <= chars // 100).groupBy("__id").agg(
        F.min_by(text, F.struct(F.xxhash64(text), F.length(text))).alias("text"), F.first("toxic").alias("toxic")
    ))
    # Lengths of at most `rows` documents, added up in the order of the hash.
    upto = W.orderBy(uniform("__id", seed=3), "__id").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = single.select("__id", F.sum(F.length("text")).over(upto).alias("__upto")).where(F.col("__upto") <= chars)
    return stored(single.join(F.broadcast(stored(within.select("__id"))), "__id").drop("__id"))


def _distinct_words(batches):
    for batch in batches:
        words, toxic = [], []
        for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
            found = {p for w in set(TOKEN.findall(t.as_py().lower())) - BREAKS for p in parts(w)}
            words += found
            toxic += [y] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.float64())], ["word", "toxic"])


def telling_words(sample):
    """Words and word beginnings whose share of the toxic and of the other documents differs most surely (z at least LEAST_Z)."""
    n, n1 = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n1 = n1 or 0.0
    n0 = n - n1
    if not n1 or not n0:
        return []
    counts = sample.mapInArrow(_distinct_words, "word string, toxic double").groupBy("word").agg(
        F.sum("toxic").alias("c1"), F.count(F.lit(1)).alias("c")
    )
    p = F.col("c") / F.lit(float(n))
    z = (F.col("c1") / n1 - (F.col("c") - F.col("c1")) / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    chosen = counts.where((F.col("c") >= LEAST_DOCS) & (F.col("c") < n)).withColumn("z", z).where(F.abs("z") >= LEAST_Z)
    return [r["word"] for r in chosen.orderBy(F.abs("z").desc(), "word").limit(WORDS).collect()]


def sentence_words(text, features):
    """Number of sentences (at least one), and the indexed words of those that have any."""
    plain, telling, words, seen = 0, [], [], False
    for token in TOKEN.findall(text.lower()):
        if token in BREAKS:
            if words:
                telling.append(words)
                words = []
            elif seen:
                plain += 1
            seen = False
        else:
            seen = True
            words += features[token]
    if words:
        telling.append(words)
    elif seen:
        plain += 1
    return max(1, plain + len(telling)), telling


def _bags(batches, features):
    for batch in batches:
        n, bags = zip(*(sentence_words(t.as_py(), features) for t in batch.column(0))) if batch.num_rows else ((), ())
        kind = pa.list_(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int32()), pa.array(bags, kind)], ["toxic", "n", "bags"])


def train(sample):
    """(words, weights, bias) maximising the likelihood of the documents' labels under the noisy-or.

    A sentence's score is the logistic of bias and weights of its words; a document is
    toxic unless every sentence is not. The words' sentences of the bounded sample (SAMPLE_ROWS
    documents, SAMPLE_CHARS code points) are all that the driver holds. Without labels of both kinds the
    model is the bias of the labels' rate.
    """
    words = telling_words(sample)
    features = _Features(words)
    rows = sample.mapInArrow(lambda it: _bags(it, features), "toxic double, n int, bags array<array<int>>").collect()
    y = np.array([r["toxic"] for r in rows])
    bags = [(d, b) for d, r in enumerate(rows) for b in r["bags"]]
    doc = np.array([d for d, _ in bags], dtype=np.int64)
    sentence = np.repeat(np.arange(len(bags)), [len(b) for _, b in bags])
    word = np.array([w for _, b in bags for w in b], dtype=np.int64)
    plain = np.array([r["n"] for r in rows], dtype=float) - np.bincount(doc, minlength=len(rows))
    theta, first, second = np.zeros(len(words) + 1), 0.0, 0.0
    theta[-1] = -6.0
    for step in range(1, STEPS + 1 if len(rows) else 1):
        z = theta[-1] + np.bincount(sentence, theta[word], len(bags))
        none = np.logaddexp(0, z)  # -log of the chance that the sentence is clean
        clean = np.maximum(plain * np.logaddexp(0, theta[-1]) + np.bincount(doc, none, len(rows)), 1e-12)
        pull = np.where(y > 0.5, -1 / np.expm1(np.minimum(clean, 500)), 1.0)
        at = pull[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, at[sentence], len(words)), at.sum() + (pull * plain).sum() / (1 + np.exp(-theta[-1])))
        grad = grad / len(rows) + 1e-5 * np.append(theta[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return words, [float(x) for x in theta[:-1]], float(theta[-1])


def _clean_chance(text, features, weights, bias):
    """-log of the chance that no sentence is toxic."""
    n, bags = sentence_words(text, features)
    return (n - len(bags)) * np.logaddexp(0, bias) + sum(np.logaddexp(0, bias + sum(weights[w] for w in b)) for b in bags)


def _scored(batches, model, threshold):
    words, weights, bias = model
    features = _Features(words)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        scores, spans = [], []
        for t in batch.column(0):
            text = t.as_py() or ""
            score = float(-np.expm1(-_clean_chance(text, features, weights, bias)))
            scores.append(score)
            spans.append(list(offending(text, model, features, threshold)) if score >= threshold else [])
        rest = [batch.column(i) for i in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(scores, pa.float64()), pa.array(spans, kind)], [*batch.schema.names[1:], "score", "offending"]
        )


def offending(text, model, features, threshold=THRESHOLD):
    """(start, end, score) of the sentences at the threshold or above, in code points."""
    _, weights, bias = model
    start = 0
    for m in [*re.finditer(r"[.!?\n]", text), None]:
        end = m.end() if m else len(text)
        bag = [i for w in TOKEN.findall(text[start:end].lower()) if w not in BREAKS for i in features[w]]
        score = float(1 / (1 + np.exp(-(bias + sum(weights[w] for w in bag)))))
        if score >= threshold and end > start:
            yield {"start": start, "end": end, "score": score}
        start = end


def score(docs, model, keep=("doc_id",), threshold=THRESHOLD):
    """Kept columns, score, offending sentences (start, end, score) and predicted (1 from the threshold on).

    Whole texts are scored where they are read, no row moves. Null and empty texts are one
    clean-looking sentence; rows repeat as in the input.
    """
    read = docs.select("text", *keep)
    schema = "".join(f"`{c}` {read.schema[c].dataType.simpleString()}, " for c in keep)
    found = read.mapInArrow(
        lambda it: _scored(it, model, threshold), schema + "score double, offending array<struct<start:int,end:int,score:double>>"
    )
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _clean(batches, model, threshold, text):
    words, weights, bias = model
    features = _Features(words)
    for batch in batches:
        none = [_clean_chance(t.as_py() or "", features, weights, bias) for t in batch.column(text)]
        yield batch.filter(pa.array(-np.expm1(-np.array(none, dtype=float)) < threshold, pa.bool_()))


def clean_documents(docs, labels, threshold=THRESHOLD):
    """Documents whose score is below the threshold, all columns kept; the model is trained on their labels.

    Null texts count as empty, which is clean unless most labelled documents are toxic; an
    empty table stays empty, repeated rows are judged alike, and without labels none goes.
    """
    model = train(labelled_sample(docs, labels))
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _clean(it, model, threshold, at), docs.schema)
