"""Every core query that has SQL, against it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from shelfspark.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data), sorted(columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, FOLDER)
    want = tables.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
