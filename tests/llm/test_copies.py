"""Exact dedup against plain grouping, with forced collisions, and against SQL on the given table."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import copies
from tidelog.llm.base import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROWS = [(5, "a"), (3, "a"), (9, "b"), (1, None), (2, ""), (None, ""), (None, "c"), (None, "c"), (7, "d"), (7, "d"), (4, "A"),
        (8, "x" * 300_000), (6, "x" * 300_000), (10, "x" * 300_000 + "y"), (11, "é\n"), (12, "é\n")]
SCHEMA = "doc_id long, text string"


def plain(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (max if keep == "largest" else min)(known) if known else None
        sha, first = hashlib.sha256(text.encode()).hexdigest(), True
        for i in ids:
            out.append((i, stays, len(ids), i == stays and first, sha))
            first = first and i != stays
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("key_bytes", [16, 0])
def test_against_plain_grouping(spark, keep, key_bytes):
    docs = spark.createDataFrame(ROWS * 2, SCHEMA).repartition(5)
    got = copies.mark_copies(docs, keep, key_bytes=key_bytes)  # with no key at all every text collides
    assert sorted(map(tuple, got.collect()), key=str) == plain(ROWS * 2, keep)


def test_some_keys_collide(spark):
    rows = [(i, f"t{i % 700}") for i in range(2000)]
    got = copies.mark_copies(spark.createDataFrame(rows, SCHEMA), key_bytes=1)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, "smallest")


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(*r, k, 1, "z") for k, r in enumerate(ROWS * 2)], f"{SCHEMA}, key int, row int, kept string")
    out = copies.drop_copies(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(3, "a"), (9, "b"), (1, None), (None, "c"), (7, "d"), (4, "A"), (6, "x" * 300_000),
                          (10, "x" * 300_000 + "y"), (11, "é\n")], key=str)


def test_reruns_keep_the_same_row_of_equal_ids(spark):
    docs = spark.createDataFrame([(1, "a", f"s{i}") for i in range(40)], f"{SCHEMA}, source string")
    assert copies.drop_copies(docs.repartition(7)).collect() == copies.drop_copies(docs.repartition(3)).collect()


def test_normalised_texts(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], SCHEMA)
    out = copies.mark_copies(docs, "largest", F.lower).filter("kept")
    assert sorted((r["doc_id"], r["group_size"]) for r in out.collect()) == [(2, 2), (3, 1)]
    assert {r["doc_id"] for r in copies.drop_copies(docs, normalise=F.lower).collect()} == {1, 3}
    with pytest.raises(ValueError):
        copies.mark_copies(docs, "newest")


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert copies.mark_copies(docs).collect() == [] and copies.drop_copies(docs).collect() == []


def test_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = con.execute(ORACLES["op13_exact_dedup"])
    names = [d[0] for d in result.description]
    got = QUERIES["op13_exact_dedup"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())
