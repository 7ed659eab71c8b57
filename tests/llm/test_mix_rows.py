"""The mix stage on rows that share an id, a source and a size."""

from collections import Counter

import pytest

import corpus_pipeline as P


def test_equal_rows_get_their_own_copies(spark):
    rows = [(1, "a b c d e", "big")] * 300 + [(None, f"n{i} b c d e", "big") for i in range(300)]
    rows += [(2, f"t{i} b c d e", "big") for i in range(300)]
    rows += [(1000 + i, "u v w x y", "low") for i in range(60)] + [(2000 + i, f"s{i} q r s t", "mid") for i in range(400)]
    docs = P.stage(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    got = P.mix_sources(spark, docs, "").collect()
    target = {r["source"]: r["target"] for r in P.mixing.source_targets(
        docs.select("source", P.word_count(P.F.col("text")).alias("size")), P.mixing.WEIGHTS, P.mixing.CAP).collect()}
    assert target["big"] < 900 * 5 / 3
    words = Counter(r["source"] for r in got)
    for source, want in target.items():
        assert words[source] * 5 == pytest.approx(want, abs=5)
    pairs = Counter((r["doc_id"], r["text"], r["copy"]) for r in got)
    assert max(pairs.values()) == 1
    repeated = sorted(r["copy"] for r in got if r["doc_id"] == 1)
    assert repeated == list(range(1, len(repeated) + 1)) and 0 < len(repeated) < 150
