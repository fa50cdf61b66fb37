"""Queries with SQL against DuckDB."""

import os

import duckdb
import pytest

from kinlink.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    want = sorted(str(r) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in QUERIES[name](spark, sf).select(*columns).collect()) == want


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
