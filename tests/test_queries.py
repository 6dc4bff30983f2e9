"""Every core query with SQL gives the SQL's rows on the smallest tables; the others run."""

import glob
import os

import pytest

import __spark_entry__ as entry
from spanloom import queries as core

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
SLOW = {"lexical_topk", "lexical_within", "two_view_overlap", "chrf_pairs", "ann_recall"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float) or type(v).__name__ in ("float64", "Decimal"):
        return f"{float(v):.5f}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - SLOW))
def test_query(spark, con, name):
    got = core.QUERIES[name](spark, FOLDER).toPandas()
    if name in core.ORACLE:
        want = con.execute(core.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for p, q in zip(x, y):
                assert p == q or float(p) == pytest.approx(float(q), abs=1e-4)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
