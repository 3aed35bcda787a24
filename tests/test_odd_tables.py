"""Registered queries against their SQL on small tables with what larger ones have: shared addresses, shared numbers of pairs."""

import pytest

from corpusloom.jobs.queries import QUERIES, SQL


def same(spark, folder, name, **tables):
    """Whether the query's rows on these tables (rows, schema) are those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for k, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{k}.parquet")
        con.sql(f"create view {k} as select * from '{folder}/{k}.parquet/*.parquet'")
    due = con.sql(SQL[name])
    own = QUERIES[name](spark, str(folder)).select(*due.columns).collect()
    plain = lambda rows: sorted(tuple(str(round(v, 5) if isinstance(v, float) else v) for v in row) for row in rows)
    rows = due.fetchall()
    return plain(own) == plain(rows) and len(rows) > 0


def test_pages_that_share_an_address(spark, tmp_path):
    pages = [(i, f"http://a/{i % 3}" if i % 5 else None, "") for i in range(24)]
    assert same(spark, tmp_path, "located_files", pages=(pages, "page_id long, url string, html string"))


def test_pairs_that_share_a_number(spark, tmp_path):
    """(1, 100005) and (2, 5) are one number: the longer history stands. A pair of a null has no number."""
    lines = [(1, 100_005, 1.0), (2, 5, 11.0), (3, 100_007, 11.0), (4, 7, 12.0), (3, None, 2.0), (5, 1, 5.0), (5, 1, 3.0), (6, 1, None), (7, 2, 9.0)]
    assert same(spark, tmp_path, "repair_rounds", lineitem=(lines, "l_suppkey long, l_partkey long, l_quantity double"))
