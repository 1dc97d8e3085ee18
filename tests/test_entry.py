"""Every query with SQL equals it on the smallest tables; the others return rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from huegraph.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "w", "total", "max"] and df.count() == 128


def test_every_query_is_registered():
    assert queries.QUERIES.keys() <= entry.queries().keys()
    assert oracle.ORACLE_SQL.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(oracle.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    as_text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert as_text(got.select(*cols).collect()) == as_text(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - oracle.ORACLE_SQL.keys()))
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
