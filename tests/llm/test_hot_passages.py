"""Repeated passages whose grams are hot: cut into parts, with the same result."""

import numpy as np
import pyarrow as pa
import pytest

from parapet.llm import suffixes
from tests.llm.test_operators import ODD, Counter, brute_repeats, prose

PASSAGE = prose(40, 77)


def test_hot_grams_in_parts(make, spread, monkeypatch):
    for name, value in (("HOT_SUFFIXES", 20), ("HOT_TIMES", 0), ("LEAST_HOT", 100), ("SAMPLED", 1)):
        monkeypatch.setattr(suffixes, name, value)
    docs = ODD + [(10 + i * 7 % 120, f"{prose(4, i)} {PASSAGE} {prose(3, 500 + i)}") for i in range(120)]
    docs += [(300 + i, PASSAGE[i % 20 :]) for i in range(40)]
    read = spread(make(docs))
    grams, parts = suffixes.hot_grams(read.select("doc_id", "text").where("text is not null"), 20, 1)
    assert len(grams) and parts.min() > 1 and (np.diff(grams.astype(object)) > 0).all()
    got = suffixes.remove_repeats(read, batches=3).collect()
    assert Counter(map(tuple, got)) == brute_repeats(docs)


@pytest.mark.parametrize("parts", [1, 8])
def test_windows_of_a_hot_gram_spread(parts):
    """A bucket of one gram gives as many groups as it has parts, none with most of the windows (equal ones stay together)."""
    texts = [f"{prose(3, i)} {PASSAGE[:60]} {prose(3, 900 + i)}".encode() for i in range(200)]
    pack = suffixes.zstandard.compress
    asked = [np.array([5]), np.array([40]), np.array([0]), np.array([1])]
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(200)), pa.array([0] * 200), pa.array([pack(t) for t in texts]), *[pa.array([x] * 200) for x in asked]],
        ["doc_id", "tag", "text", "at", "more", "bucket", "gram"])
    [out] = suffixes._windows([rows], np.array([parts]))
    sizes = [len(suffixes._unpacked_windows(b)[0]) for b, kind in zip(out.column(3), out.column(2).to_pylist()) if kind]
    assert sum(sizes) == 200 * 41 and len(sizes) == parts and max(sizes) <= sum(sizes) / max(1, parts / 3)
    order = sorted(range(out.num_rows), key=lambda i: [out.column(c)[i].as_py() for c in range(3)])
    got = suffixes._compared([out.take(pa.array(order))])
    found = {(d, a + k) for r in got for d, a, m in zip(*(r.column(i).to_pylist() for i in range(3))) for k in range(m + 1)}
    first = {}
    for t in texts[::-1]:
        first.update({t[p : p + 50]: texts.index(t) for p in range(5, 46)})
    assert found == {(d, p) for d, t in enumerate(texts) for p in range(5, 46) if first[t[p : p + 50]] < d}
