"""Corpus jobs hold the results of a bounded number of documents, and names meet texts by their real size."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidelog.functions import briefs
from tidelog.operators import audits, corpus, lineage


def test_batches_end_at_their_bound():
    schema = pa.schema([("doc_id", pa.int64()), ("clauses", pa.list_(pa.string()))])
    taken = []

    def rows():
        for i in range(50):
            taken.append(i)
            yield i, ["x" * 100_000]

    out = corpus._bounded(rows(), lambda row: sum(map(len, row[1])), schema)
    first = next(out)
    assert first.num_rows == 11 and len(taken) == 11
    assert first.num_rows + sum(b.num_rows for b in out) == 50
    assert [b.num_rows for b in corpus._bounded(((i, []) for i in range(5000)), lambda row: 0, schema)] == [4096, 904]


def test_clauses_and_chunks_of_every_document(spark):
    texts = ["# Task\n\nDo the work. Never touch it.\n", "", None, "plain text\nof two lines", "word " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["clauses"] for r in corpus.narrow_scope(docs).collect()}
    assert got == {i: briefs.narrow(t) if t is not None else [] for i, t in enumerate(texts)}
    chunks = sorted((r["doc_id"], r["k"], r["chunk"]) for r in corpus.chunk_texts(docs, 100, 5).collect())
    assert chunks == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(briefs.cut(t or "", 100, 5)[0], 1)]


def test_strings_of_texts_do_not_move_to_few_names(spark, monkeypatch):
    plans, cut = [], lineage.cut
    monkeypatch.setattr(audits.lineage, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    names = spark.range(1 << 22).select(F.concat(F.lit("name"), (F.col("id") % 3).cast("string")).alias("name"))
    tests = spark.createDataFrame([(1, "has name1 in it"), (2, "none"), (3, "name0name2")], "test long, text string")
    found = audits.tests_referencing(names, tests)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
    assert sorted(map(tuple, found.collect())) == [("name0", 3), ("name1", 1), ("name2", 3)]
