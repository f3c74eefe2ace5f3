"""Every registered query of the reference's operators against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from tideq.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
