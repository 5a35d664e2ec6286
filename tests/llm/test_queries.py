"""Every registered query with SQL gives the same rows as it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from stratafold.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    sql = tables.execute(registry.ORACLES[name])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in sql.fetchall())


def test_all_are_in_the_entry():
    names = {f"op{i}" for i in range(1, 11)}
    assert {n.split("_")[0] for n in registry.QUERIES} == names
    assert set(registry.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
