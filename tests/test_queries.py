"""Every query against its SQL in DuckDB, on the smallest tables, and what the driver expects of the entry module."""

import os

import pytest

from netloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def normal(rows, names):
    def one(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.SQL:
        assert got
        return
    cursor = duck.execute(catalog.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(got, df.columns) == normal(cursor.fetchall(), names)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 240
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
