"""SimHash groups against brute force over all pairs."""

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from tidelog.llm import simhash as S
from tidelog.llm.base import QUERIES

SF = "/root/testdata/sf0.001"


def check(spark, rows):
    rows = sorted(rows, key=lambda r: r[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in S.link_documents(docs).collect()}
    fps = [plain.fingerprint(t) for _, t in rows]
    comps = plain.components(fps)
    want = {r[0]: (f, rows[c][0]) for r, f, c in zip(rows, fps, comps, strict=True)}
    assert got == want


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
    out = QUERIES["op3_simhash"](spark, SF)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert out.filter(F.length("fingerprint") != 16).count() == 0 and out.count() == len(rows)


def test_odd_texts(spark):
    check(spark, [(5, None), (3, ""), (9, " \t\n"), (1, "One"), (2, "oNE"), (4, "a b c d"), (6, "a b c d e f " * 4000),
                  (7, "É É É É"), (8, "é É É É"), (10, "a\x1cb \x85 c")])


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, t int")
    assert S.link_documents(empty).collect() == []


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "x y"), (2, "x y"), (2, "x y"), (None, "q")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.link_documents(docs).collect()), key=str)
    assert got == sorted([(None, 2), (2, 2), (2, 2), (None, None)], key=str)


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_cover_hides_any_radius_bits(radius):
    masks = S.cover_masks(radius).view(np.uint64)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = np.random.default_rng(3)
    for _ in range(2000):
        flips = rng.choice(64, radius, replace=False)
        diff = np.uint64(sum(1 << int(b) for b in flips))
        assert ((masks & diff) == 0).any()


def test_large_ball_has_a_spanning_forest():
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))
    near = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(3000)}
    far = {int(x) for x in rng.integers(0, 2**63, 500)}
    members = np.array(sorted(near | far), np.uint64)
    links = S.spanning_links(members)
    assert len(links) < len(members)
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    small = members[::7]
    roots = plain.components([int(x) for x in small])
    assert len(small) - len(S.spanning_links(small)) == len(set(roots))


def test_chained_members_through_run_boundaries(spark):
    rows = [(i,) for i in range(200)]
    nodes = spark.createDataFrame(rows, "fp long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        links = [(r["a"], r["b"]) for r in S.near_links(nodes).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    root = {i: i for i in range(200)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert (a ^ b).bit_count() <= 4
        root[find(a)] = find(b)
    assert len({find(i) for i in range(200)}) == 1
