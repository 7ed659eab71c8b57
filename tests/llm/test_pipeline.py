"""The pipeline's stages against plain versions of each, on each stage's own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for _, function in P.STAGES:
        made.append(P.stage(function(spark, made[-1], SF)))
    return made


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert steps[-1].columns == [*steps[0].columns, "copy"]
    assert [name for name, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"]


def test_quality_keeps_good_documents(spark, steps):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(steps[1]))
    good = [d for d, q in truth.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_line_stage(steps):
    rows = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    want = plain.lines(list(rows.items()))
    got = steps[2].collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_near_stage(steps):
    rows = sorted((r["doc_id"], r["text"]) for r in steps[2].collect())
    assert ids(steps[3]) == plain.near_copies(rows)


def test_leak_stage(spark, steps):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(t.lower().split())
    rows = {r["doc_id"]: flat(r["text"]) for r in steps[3].collect()}
    exact = {d for d, t in rows.items() if any(flat(i) in t for i in items)}
    gone = set(rows) - set(ids(steps[4]))
    assert exact <= gone
    for d in gone - exact:
        assert any(plain.edits(flat(i), rows[d]) <= 0.08 * len(flat(i)) for i in items)


def test_mix_stage(steps):
    size = {r["doc_id"]: (r["source"], len(r["text"].encode().split())) for r in steps[4].collect()}
    total, taken = sum(n for _, n in size.values()), {}
    copies = [(r["doc_id"], r["copy"]) for r in steps[5].collect()]
    assert len(set(copies)) == len(copies) and max(c for _, c in copies) <= 3
    for d, _ in copies:
        taken[size[d][0]] = taken.get(size[d][0], 0) + size[d][1]
    assert sum(taken.values()) == pytest.approx(total, rel=0.03)


def test_run_is_the_last_stage(spark, steps):
    again = P.run(spark, SF)
    assert again.columns == steps[-1].columns
    assert sorted(map(tuple, again.select("doc_id", "copy").collect())) == sorted(map(tuple, steps[-1].select("doc_id", "copy").collect()))


def test_stages_take_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (2, "x", None, None, 1)], base.schema
    )
    named = {c: F.lit("k") for c in ("copies", "copy", "n_lines", "n_removed", "group", "node", "did", "size", "rate")}
    df = base.unionByName(odd).withColumns(named)
    for _, function in P.STAGES:
        df = P.stage(function(spark, df, SF))
    assert df.columns == [*base.columns, *[c for c in named if c != "copy"], "copy"] and df.count() > 0
    none = base.limit(0)
    for _, function in P.STAGES:
        none = P.stage(function(spark, none, SF))
    assert none.collect() == []
