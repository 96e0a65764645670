"""Every registered query runs; those with SQL give the same rows as DuckDB on the same files."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftwork.plans import registry

SF = "/root/testdata/sf0.001"


def cell(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    c.execute("set timezone='UTC'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = registry.oracles().get(name)
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert sorted(names) == columns
        assert mine == sorted(tuple(cell(r[i]) for i in order) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
