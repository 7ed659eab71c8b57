"""Every registered query against its SQL on the given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6))
        return "NULL" if v is None else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows), [columns[i] for i in order]


catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows, f"{name} gives no rows"
    sql = catalog.ORACLES.get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    got, got_columns = canonical(df.columns, rows)
    want, want_columns = canonical(columns, result.fetchall())
    assert got_columns == want_columns
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_are_the_known_ones():
    missing = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert missing == {
        "scope_clauses", "chunk_texts", "risk_scan", "batch_escalations", "stream_timers", "stream_replies",
    }
