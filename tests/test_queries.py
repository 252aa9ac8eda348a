"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from parapet.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def text(v):
    return f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else repr(v)


def test_all_queries_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    cursor = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(tuple(text(v) for _, v in sorted(zip(columns, r))) for r in cursor.fetchall())
    got = sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(columns)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "verdict", "filters", "n_hits"]
