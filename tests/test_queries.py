"""Every registered query against its SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest

from quaverlake.catalog_queries import QUERIES, SQL

DIR = "/root/testdata/sf0.01"
TABLES = ["supplier", "part", "lineitem", "customer", "documents", "benchmark", "pages", "events", "orders"]


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str)
    if name not in SQL:
        assert rows
        return
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=str)
    assert len(rows) == len(want) and rows == want
    assert rows
