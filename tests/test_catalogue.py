"""Every registered query of the core against its SQL, over the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from factloom.plans import built, catalog, facts, problems, served

ROOT = "/root/testdata/sf0.001"
MODULES = (catalog, problems, facts, built, served)
QUERIES, SQL = ({k: v for m in MODULES for k, v in getattr(m, what).items()} for what in ("QUERIES", "SQL"))

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, ROOT)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    expected = duck.execute(SQL[name])
    assert got == bag([c[0] for c in expected.description], expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, ROOT)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_core_does_not_know_the_text_package():
    import factloom

    root = os.path.dirname(factloom.__file__)
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "factloom.llm" not in f.read(), path
