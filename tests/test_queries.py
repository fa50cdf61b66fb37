"""Every linkage query with SQL against DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pytest

from kinlink.plans.catalogue import FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(r) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want


def test_flagship(spark, sf):
    assert FLAGSHIP(spark, sf).count() > 0


def test_entry_stands_without_the_llm_folders(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "kinlink", tmp_path / "kinlink", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
