"""Queries of the training-data problems against DuckDB on the same files, and on other partitionings."""

import glob
import os

import duckdb
import pytest

from weftwork.llm import queries

SF = "/root/testdata/sf0.001"


def cell(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    c.execute("set timezone='UTC'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    columns, mine = rows(queries.QUERIES[name](spark, SF))
    sql = queries.ORACLES.get(name)
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert sorted(names) == columns
        assert mine == sorted(tuple(cell(r[i]) for i in order) for r in cur.fetchall())
    else:
        assert len(mine) == len(set(mine)) or name not in {n for n in queries.QUERIES if n.endswith("_found")}


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p5_found", "p9_mix", "p10_found"])
def test_same_rows_at_other_partitionings(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = rows(queries.QUERIES[name](spark, SF))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert rows(queries.QUERIES[name](spark, SF)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
