"""Line dedup against plain comparison of all pairs, and against SQL on the given table."""

import random

import duckdb
import plain
import pytest

from tidelog.llm import lines as L
from tidelog.llm.base import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"




@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 70))] for _ in range(25)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 9)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                line = line[rng.randint(0, 3) :]
            text.append(rng.choice([" ", "\t", "  "]).join(line))
        rows.append((i, "\n".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()}
    assert got == plain.lines(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a b\n \na  b\nA b"), (None, "a b\nc"), (5, "x " * 3000), (6, "\n" + "x " * 3000)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, no string, n int")
    out = L.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "no", "n", "n_lines", "n_removed"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == plain.lines(rows)
    assert got[4] == "a b\n \nA b" and got[None] == "c" and got[1] is None
    assert L.dedup_lines(docs.limit(0)).collect() == []


def placed_by_rows(rows):
    """Plain result for rows whose ids repeat: which of the rows that share an id comes first is free, so texts are sorted."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    got = plain.lines([(n, rows[k][1]) for n, k in enumerate(order)])
    return sorted((str(rows[k][0]), str(got[n])) for n, k in enumerate(order))


def test_rows_that_share_an_id_or_have_none(spark):
    rows = [(None, "p q r\nx"), (None, "y\nk l"), (None, "p q r\nx"), (3, "a b c\nd e"), (3, "a b c\nd e"), (2, "d e\nz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = L.dedup_lines(docs)
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
    assert got == placed_by_rows(rows)
    assert out.agg({"n_removed": "sum"}).first()[0] == 5


@pytest.mark.parametrize("seed", range(2))
def test_repeated_ids_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(12)]
    rows = [(rng.choice([None, 1, 2, 3, 4]), "\n".join(rng.choice(base) for _ in range(rng.randint(0, 5)))) for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in L.dedup_lines(docs).collect())
    assert got == placed_by_rows(rows)


def test_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "a\nb\na", 7, 8, "k", "m")], "doc_id long, text string, n_lines int, n_removed int, did string, h string")
    assert L.dedup_lines(docs, counts=False).collect() == [(1, "a\nb", 7, 8, "k", "m")]
    out = L.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "did", "h", "n_lines", "n_removed"] and tuple(out.first()) == (1, "a\nb", "k", "m", 3, 1)


def test_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op10_line_dedup"]).fetchall())
    out = QUERIES["op10_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_removed", "text")
    assert sorted(tuple(r) for r in out.collect()) == want


def families(seed, n=30):
    """Lines that vary a few long ones, and others that share their beginnings only."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(25, 60))] for _ in range(4)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(4):
            line = list(rng.choice(base))
            if rng.random() < 0.4:
                line = line[: rng.randint(6, 20)] + [rng.choice(words) for _ in range(rng.randint(5, 30))]
            for _ in range(rng.choice([0, 1, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(" ".join(line))
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("crowd", [1, 3, 12])
def test_crowded_tokens_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(L, "CROWD", crowd)
    used = []
    levels = L.rarity_levels
    monkeypatch.setattr(L, "rarity_levels", lambda sets: used.append(1) or levels(sets))
    rows = families(crowd)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()} == plain.lines(rows)
    assert used


def test_texts_without_crowded_tokens_are_not_counted(spark, monkeypatch):
    monkeypatch.setattr(L, "rarity_levels", None)
    rows = families(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()} == plain.lines(rows)


def test_repeated_lines_give_no_tokens(spark, monkeypatch):
    rows = families(9, 8)
    rows += [(100 * k + i, text) for k in range(1, 5) for i, text in rows]
    seen = []
    whole = L.prefixes
    monkeypatch.setattr(L, "prefixes", lambda lines: seen.append(lines.select("line").collect()) or whole(lines))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()} == plain.lines(rows)
    assert len(seen) == 1 and sorted(r["line"] for r in seen[0]) == sorted({x for _, text in rows for x in text.split("\n")})


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("ids", [1, 2])
def test_no_shuffle_files_are_left(spark, ids):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    docs = spark.createDataFrame([(i // ids, text) for i, text in families(11)], "doc_id long, text string").repartition(4)
    docs.count()
    there = shuffle_files(spark)
    out = L.dedup_lines(docs)
    assert not shuffle_files(spark) - there
    assert spark.conf.get(key, None) == before
    assert out.count() == out.count() == 30
