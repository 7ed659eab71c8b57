"""Suffix arrays and repeated bytes against plain search."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import suffixes as S
from tidelog.llm.base import QUERIES

SF = "/root/testdata/sf0.001"


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    length = options.get("length", S.LENGTH)
    got = sorted((tuple(r)[:5] for r in S.remove_repeats(docs, **options).collect()), key=str)
    want = sorted(((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows], length))), key=str)
    assert got == want
    return sum(w[2] for w in want)


def texts_with_repeats(seed, n=60, alphabet="abcdefgé "):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [make(rng.randint(30, 200)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [make(rng.randint(0, 120)), rng.choice(shared), make(rng.randint(0, 60)), rng.choice(shared)[5:]]
        rows.append((i, "".join(parts)))
    return [*rows, (1000, rows[3][1]), (1001, rows[3][1][:-1]), (1002, "a" * 700), (1003, "ab" * 500)]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1500])
def test_repeats_of_random_texts(spark, shard_bytes):
    assert check(spark, texts_with_repeats(1), length=64, gram=8, shard_bytes=shard_bytes) > 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check(spark, rows) > 0
    out = QUERIES["op7_suffix_dedup"](spark, SF)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    assert all(len(r["text"].encode()) >= r["n_bytes"] - r["n_removed"] for r in out.collect())
    assert check(spark, rows, shard_bytes=4000) > 0


def test_odd_rows(spark):
    long = texts_with_repeats(2)[0][1] * 9
    check(spark, [(1, None), (2, ""), (3, "x" * 399), (4, "y" * 400), (None, long), (5, long), (5, "z" + long), (5, long)])
    empty = spark.createDataFrame([], "doc_id long, text string, key int, mark int")
    assert S.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    raw = rng.integers(0, 3, 700).astype(np.uint8) + 97
    raw[300:500] = raw[50:250]
    if seed == 3:
        raw[:] = 97
    data, depth = raw.tobytes(), 64
    order = S.suffix_array(raw, depth)
    cut = [(data[i : i + depth] + b"\0" * depth)[:depth] for i in order]
    assert cut == sorted(cut) and sorted(order) == list(range(len(raw)))
    common = S.common_prefixes(raw, order, depth)
    for a, b, c in zip(order, order[1:], common[1:]):
        x, y = data[a:], data[b:]
        real = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert min(c, depth) == min(real, depth)
