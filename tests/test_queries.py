"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from ruleloom.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, cursor = QUERIES[name](spark, FOLDER), duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: [(x is not None, str(x)) for x in r]
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(cursor.fetchall(), key=key)
