"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenframe import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(found):
    def value(x):
        if isinstance(x, bool):
            return int(x)
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5)
        if isinstance(x, (list, tuple)):
            return tuple(map(value, x))
        return float(x) if type(x).__name__ == "Decimal" else x

    return sorted((tuple(map(value, r)) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows(got.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
