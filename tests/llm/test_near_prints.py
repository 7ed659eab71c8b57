"""The SimHash step of the near-copy stage."""

import random

import numpy as np
import plain

import corpus_pipeline as P
from tidelog.llm import near, simhash


def test_fingerprints_of_hashed_shingles():
    text = b" ".join(b"w%d" % i for i in range(40_000))
    assert simhash.simhash_of(near.shingle_set(text)) == simhash.simhash(text, near.SHINGLE)
    assert simhash.simhash_of(np.empty(0, np.uint64)) == simhash.simhash(None) == 0


def test_fingerprints_link_near_copies_without_bands(spark, monkeypatch):
    """With no band that two sets share, long texts with one word changed still meet, and unlike ones stay."""
    monkeypatch.setattr(near, "band_hashes", lambda shingles: np.empty(0, np.uint64))
    rng = random.Random(4)
    rows = []
    for c in range(5):
        words = [f"c{c}w{rng.random()}" for _ in range(800)]
        rows += [(10 * c, " ".join(words)), (10 * c + 1, " ".join([*words[:-1], "other"]))]
    docs = P.stage(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in P.drop_near_copies(spark, docs, "").select("doc_id").collect()) == plain.near_copies(rows)
    assert plain.near_copies(rows) == [0, 10, 20, 30, 40]
