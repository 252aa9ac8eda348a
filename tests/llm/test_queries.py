"""The registered queries and the pipeline on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from parapet.llm import queries, simhash
from tests.llm.test_operators import brute_components, brute_print, brute_repeats, brute_spans, check_packing

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def docs(tables):
    return tables.execute("select doc_id, text, source from documents order by doc_id").fetchall()


def test_one_query_per_operator():
    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, tables, name):
    cursor = tables.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(cursor.fetchall())


def test_packing(spark, docs):
    check_packing(queries.op1_pack(spark, DATA).collect(), docs, 2048)


def test_fingerprints_and_scores_cover_all(spark, docs):
    ids = [d for d, *_ in docs]
    for name in ("op3_fingerprint", "op4_toxicity", "op8_mix", "op10_shard"):
        assert sorted(r.doc_id for r in queries.queries()[name](spark, DATA).select("doc_id").collect()) == ids


def test_repeats(spark, docs):
    assert sum(brute_repeats([d[:2] for d in docs]).values()) == len(docs)
    want = brute_repeats([d[:2] for d in docs])
    assert {tuple(r) for r in queries.op5_suffixes(spark, DATA).collect()} == set(want)


def test_personal_data(spark, docs):
    import hashlib

    got = {r.doc_id: r for r in queries.op6_pii(spark, DATA).collect()}
    for doc_id, text, _ in docs:
        spans = list(brute_spans(text or ""))
        assert got[doc_id].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[doc_id][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone")]


def test_simhash(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, DATA).collect()}
    prints = {d: brute_print(t) for d, t, _ in docs}
    group = brute_components(prints.values())
    least = {}
    for d, p in prints.items():
        least[group[p]] = min(least.get(group[p], d), d)
    assert got == {d: (f"{p:016x}", least[group[p]]) for d, p in prints.items()}


def test_pipeline_by_stages(spark, docs):
    """Each stage against a plain version of what it does to its own input."""
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    clean = stages["toxicity"](spark, frame, DATA)
    rejected = {r.doc_id for r in frame.select("doc_id").subtract(clean.select("doc_id")).collect()}
    assert clean.columns == frame.columns and len(rejected) < 0.2 * len(docs)

    single = stages["near_duplicates"](spark, frame, DATA)
    prints = {d: brute_print(t) for d, t, _ in docs}
    group, least = brute_components(prints.values()), {}
    for d, p in prints.items():
        least[group[p]] = min(least.get(group[p], d), d)
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values()) and single.columns == frame.columns

    private = stages["pii"](spark, frame, DATA)
    assert private.columns == frame.columns and private.count() == len(docs)
    for r in private.collect():
        assert not [s for s in brute_spans(re.sub(r"\[[A-Z]+\]", "#", r.text or "")) if s.startswith(("email", "phone"))]

    mixed = stages["mixing"](spark, frame, DATA)
    assert mixed.columns == frame.columns and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    check_packing(stages["packing"](spark, frame, DATA).collect(), docs, 2048)


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert simhash.RADIUS == 3
