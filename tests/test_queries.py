"""Registered queries against DuckDB on the small tables, where those exist."""

from pathlib import Path

import pytest

from corpusloom.jobs.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def told(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: round(float(v), 5) if isinstance(v, float) else v).astype(str)
    return sorted(map(tuple, frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    own, other = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert told(own) == told(other)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() >= 0


def test_entry_works_without_the_corpus_operators():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
