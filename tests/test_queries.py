"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lipika.plans import catalog, oracles

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables")


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    want = duck.sql(oracles.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    place = [want.columns.index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in place] for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracles.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
