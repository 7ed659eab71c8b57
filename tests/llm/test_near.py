"""The near-copy stage against brute-force Jaccard similarity over all pairs."""

import random

import numpy as np
import plain
import pytest

import corpus_pipeline as P
from tidelog.llm import near

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def copies(spark):
    """Documents, and copies re-wrapped to 12 words a line with one word in 20 to 90 replaced."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).select("doc_id", "text").collect()
    rng, rows = random.Random(5), [(r["doc_id"], r["text"]) for r in docs]
    texts = [t for _, t in rows if t and 60 <= len(t.split()) <= 600]
    for k in range(300):
        words = texts[k % len(texts)].split()
        every = rng.choice((20, 30, 45, 70, 90))
        words = [f"new{rng.random()}" if rng.randrange(every) == 0 else w for w in words]
        rows.append((100_000 + k, "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))))
    return rows


def test_stage_against_brute_force(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(6)
    kept = P.drop_near_copies(spark, P.stage(docs), SF)
    want = plain.near_copies(copies)
    assert len(want) < len(copies) - 150
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == want


def test_links_through_members_that_no_leader_meets(spark):
    rng = random.Random(2)
    words = [f"w{rng.random()}" for _ in range(200)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in P.drop_near_copies(spark, P.stage(docs), SF).collect()} == set(plain.near_copies(rows)) == {0}


def test_bands_meet_at_the_bound():
    rng = np.random.default_rng(8)
    for _ in range(500):
        common, own = rng.integers(0, 1 << 63, 160, np.uint64), rng.integers(0, 1 << 63, 40, np.uint64)
        a, b = np.unique(np.concatenate((common, own[:20]))), np.unique(np.concatenate((common, own[20:])))
        assert (near.band_hashes(a) == near.band_hashes(b)).any()


def variants(n, words=200, changed=9, seed=3):
    """Texts that each differ from a common one, which is not among them, in a few words: similar to it, not to each other."""
    rng = random.Random(seed)
    base = [f"w{rng.random()}" for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(words), changed):
            text[at] = f"x{rng.random()}"
        rows.append((i, " ".join(text)))
    return rows


def test_members_that_are_not_similar_leave_no_pairs(spark, monkeypatch):
    real, counted = near.similar_pairs, []
    monkeypatch.setattr(near, "similar_pairs", lambda pairs, sets: counted.append(pairs.count()) or real(pairs, sets))
    made = []
    for n in (100, 400):
        counted.clear()
        rows = variants(n)
        docs = P.stage(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r["doc_id"] for r in P.drop_near_copies(spark, docs, SF).collect()) == plain.near_copies(rows)
        made.append(sum(counted))
    assert made[1] < 6 * made[0] and made[1] < 400 * 399 / 2 / 4


@pytest.mark.parametrize("block", [7, 2048])
def test_open_groups_meet_over_blocks_and_rounds(spark, monkeypatch, block):
    """Chains of links that leaders miss, in small blocks and with one partner a round."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "PARTNERS", 1)
    monkeypatch.setattr(near, "LEADERS", 1)
    rng = random.Random(2)
    rows = []
    for c in range(6):
        words = [f"c{c}w{rng.random()}" for _ in range(400)]
        rows += [(100 * c + i, " ".join(words[6 * i : 6 * i + 120])) for i in range(20)]
    rows += [(1000 + i, t) for i, t in variants(60)]
    docs = P.stage(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(r["doc_id"] for r in P.drop_near_copies(spark, docs, SF).collect())
    assert got == plain.near_copies(rows) and len(got) < len(rows) - 100


def test_signatures_come_near_the_bound():
    rng = np.random.default_rng(9)
    missed = 0
    for _ in range(400):
        common, own = rng.integers(0, 1 << 63, 160, np.uint64), rng.integers(0, 1 << 63, 40, np.uint64)
        pair = [np.unique(np.concatenate((common, part))) for part in (own[:20], own[20:])]
        signs = np.array([np.frombuffer(near.signature(x), np.uint64) for x in pair])
        missed += not list(near.near_partners(signs[:1], np.array([0]), signs[1:], np.array([1]), 1))
    assert missed <= 1
    far = [np.frombuffer(near.signature(rng.integers(0, 1 << 63, 50, np.uint64)), np.uint64) for _ in range(2)]
    assert list(near.near_partners(np.array(far[:1]), np.array([0]), np.array(far[1:]), np.array([1]), 1)) == []


def test_rows_that_differ_in_a_map_are_two(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'a b' AS text, map('k', v) AS m FROM VALUES (1), (2) AS t(v)")
    assert docs.select(near.row_hash(docs).alias("h")).distinct().count() == 2


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.drop_near_copies(spark, P.stage(docs), SF).collect()) == [1, 4, 6, 7]
    assert P.drop_near_copies(spark, P.stage(docs.limit(0)), SF).collect() == []


def test_exact_rows_that_stay(spark):
    long = " ".join(f"w{i}" for i in range(100))
    close = long.replace("w50", "x")
    rows = [
        (7, long, "s"), (7, long, "s"), (7, long, "t"), (9, close, "s"), (None, long, "s"), (None, long, "s"),
        (None, "only nulls here", "s"), (None, "only nulls here", "s"), (None, "only nulls here", None),
        (None, close.replace("w", "v"), "a"), (None, long.replace("w", "v"), "b"), (3, None, "s"), (3, None, "s"), (4, "", "s"),
        (5, "alone", None), (5, "apart", None),
    ]
    schema = "doc_id long, text string, source string"
    docs = P.stage(spark.createDataFrame(rows, schema).repartition(4))
    got = P.drop_near_copies(spark, docs, SF).collect()
    hashed = {tuple(r)[:3]: (r["mark"], r["row"]) for r in docs.select(
        "*", P.F.xxhash64("text").alias("mark"), near.row_hash(docs).alias("row")).collect()}
    first = lambda *some: min(some, key=hashed.get)
    want = [
        first((7, long, "s"), (7, long, "t")), first((None, "only nulls here", "s"), (None, "only nulls here", None)),
        first((None, close.replace("w", "v"), "a"), (None, long.replace("w", "v"), "b")), (3, None, "s"), (5, "alone", None),
        (5, "apart", None),
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_whole_table_twice(spark):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet")
    once, twice = (P.drop_near_copies(spark, P.stage(d), SF).collect() for d in (docs, docs.unionByName(docs)))
    assert sorted(map(tuple, once)) == sorted(map(tuple, twice))
