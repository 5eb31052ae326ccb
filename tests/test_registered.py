"""All registered queries against their SQL counterparts in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "embeddings", "labels", "conversations", "pages")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 400


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, database, name):
    out = entry.queries()[name](spark, FOLDER)
    rows = out.collect()
    assert rows
    if name not in entry.oracle_sql():
        return
    cursor = database.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(out.columns)
    order = [columns.index(c) for c in out.columns]
    expected = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
