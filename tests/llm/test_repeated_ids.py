"""Several rows under one id: texts are told apart exactly, samples stay within their bound."""

import random
import zlib

from parapet.llm import suffixes, toxicity
from tests.llm.test_operators import brute_repeats, prose

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_texts_of_one_id_are_not_mixed_up(make, spread):
    """Texts whose short hashes agree, one with a passage of an earlier document and one without."""
    passage = prose(12)
    of = lambda t: zlib.crc32(t.encode()) % (1 << 22)
    with_passage = {of(t): t for t in (f"{i} {passage}" for i in range(6000))}
    others = {of(t): t for t in (f"{i} {prose(12, 5)}" for i in range(6000))}
    same = [(2, t[x]) for x in sorted(with_passage.keys() & others.keys())[:3] for t in (with_passage, others)]
    assert same
    docs = [(1, passage), *same, (2, None), (2, ""), (3, passage + same[1][1]), (3, passage + same[1][1]), (None, passage)]
    docs += [(7, f"{i} {prose(20, i % 3)}") for i in range(300)]
    got = [tuple(r[c] for c in COLUMNS) for r in suffixes.remove_repeats(spread(make(docs))).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(brute_repeats(docs).elements(), key=key)


def test_sample_is_bounded(make, spark):
    """An id of three thousand rows is one row of the sample, the same in every run."""
    r = random.Random(1)
    docs = [(1, prose(5, i)) for i in range(3000)] + [(i, prose(5, i)) for i in range(2, 40)] + [(3, None)]
    r.shuffle(docs)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 40)], "doc_id bigint, toxic int")
    runs = [sorted(map(tuple, toxicity.labelled_sample(make(docs[::d]), labels, rows=11).collect())) for d in (1, -1)]
    assert len(runs[0]) == 11 and runs[0] == runs[1]
    every = toxicity.labelled_sample(make(docs), labels, rows=100).count()
    assert every == len({i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2})


def test_sample_is_bounded_in_characters(make, spark):
    """Ten code points a text, but for one of twenty: 1,500 in all are 150 texts, none above 15."""
    docs = make([(i, f"{i:010d}" * (2 if i == 5 else 1)) for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    texts = [r.text for r in toxicity.labelled_sample(docs, labels, chars=1500).collect()]
    assert len(texts) == 150 and {len(t) for t in texts} == {10}
    whole = toxicity.labelled_sample(docs, labels).count()
    assert whole == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(400))
