"""Every registered query with SQL is held against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from panelwright.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(catalog.queries())
#: Queries that SQL cannot express, and the test that holds each against plain Python.
PLAIN = {
    "tx1_html_text": "test_plain.py", "tx2_clean_report": "test_plain.py", "tx5_sections": "test_plain.py", "tx6_packed_paragraphs": "test_plain.py", "tx12_embeddings": "test_plain.py",
    "ml3_boosted_trees": "test_plain.py", "ml3c_staged_rounds": "test_boosting.py", "ml4_walk_forward_scores": "test_walk_forward.py", "ml4b_frozen_scores": "test_plain.py",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert name in PLAIN, "neither SQL nor a test of its own"
        return
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()]
    assert len(got) == len(want)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert type(x) is type(y), (a, b)
            assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-5), (a, b)
