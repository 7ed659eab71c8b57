"""Decontamination against plain search and plain edit distance."""

import random

import numpy as np
import plain
import pytest

from tidelog.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def test_gram_hashes_tell_grams_apart():
    text = "".join(random.Random(1).choice("abcdé ") for _ in range(4000))
    for q in (1, 2, 3, 7, 8, 10, 13):
        hashes = D.gram_hashes(D.points(text), q)
        grams = [text[i : i + q] for i in range(len(text) - q + 1)]
        assert len(hashes) == len(grams)
        assert len(set(hashes.tolist())) == len(set(grams)) == len(set(zip(hashes.tolist(), grams)))


def edit(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            out.insert(at, rng.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


def test_every_match_within_the_budget_is_found():
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [D.normalize(text(rng.randint(12, 60))) for _ in range(12)]
    index = D.Index([(i, D.points(t)) for i, t in enumerate(items)])
    for _ in range(60):
        i = rng.randrange(len(items))
        changed = edit(rng, items[i], rng.randint(0, int(index.budget[i]) + 4))
        doc = rng.choice(["", text(30) + " "]) + changed + rng.choice(["", " " + text(30)])
        want = {k: e for k, t in enumerate(items) if (e := plain.edits(t, D.normalize(doc))) <= index.budget[k]}
        assert index.find(doc) == want


def test_pieces_overlap(monkeypatch):
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefgh") for _ in range(120))
    index = D.Index([(0, D.points(item))])
    monkeypatch.setattr(D, "PIECE", 64)
    for before in range(0, 2600, 37):
        assert index.find("q" * before + item + "w" * 900) == {0: 0}


def test_table_against_plain_search(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r["doc_id"]: D.normalize(r["text"] or "") for r in docs.collect()}
    items = {r["item_id"]: D.normalize(r["text"]) for r in bench.collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.matches(docs, bench).collect()}
    assert {k for k, e in got.items() if e == 0} == exact and exact
    for (d, i), e in got.items():
        assert e <= D.RATE * len(items[i])
    clean = D.keep_clean(docs.withColumn("edits", docs.doc_id), bench)
    assert clean.columns == [*docs.columns, "edits"]
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - {d for d, _ in got}


@pytest.mark.parametrize("chars", [2_000_000, 300])
def test_odd_rows_and_blocks(spark, chars):
    long = "the quick brown fox jumps over the lazy dog and runs away from the hunters in the dark wood"
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, f"A {long.upper()}!"), (None, long.replace(" ", "\n ")), (4, "tiny x1"), (3, long)],
        "doc_id long, text string",
    )
    items = [(1, long), (2, None), (3, ""), (4, "x1"), (5, "nothing of the kind is said anywhere at all"), (1, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in D.matches(docs, bench, block_chars=chars).collect()), key=str)
    want = [(3, 1, 0)] * 4 + [(None, 1, 0)] * 2 + [(4, 4, 0)]
    assert got == sorted(want, key=str)
    empty = bench.limit(0)
    assert D.matches(docs, empty).collect() == [] and D.keep_clean(docs, empty).count() == docs.count()
    assert D.matches(docs.limit(0), bench).collect() == []


def test_alignment_at_the_ends():
    item = D.points("abcdefghij")
    assert D.align(item, D.points("cdefghij"), -6, 6) == 2
    assert D.align(item, D.points("xxabcdefgh"), -6, 6) == 2
    assert D.align(item, D.points(""), -3, 3) >= 10
    assert isinstance(D.align(item, np.empty(0, np.uint32), -3, 3), int)


def test_alignments_are_few(monkeypatch):
    """An item that stands in the text as it is needs none, an edited one a single one for all bands that touch."""
    calls, plain_align = [], D.align
    monkeypatch.setattr(D, "align", lambda *args: calls.append(args) or plain_align(*args))
    rng = random.Random(11)
    item = "".join(rng.choice("abcdefghijkl ") for _ in range(150))
    index = D.Index([(0, D.points(item))])
    assert index.find("x" * 40 + item + "y" * 40) == {0: 0} and not calls
    assert index.find("x" * 40 + item[:70] + "ZZ".lower() + item[70:] + "y" * 40) == {0: 2} and len(calls) == 1


def test_alignment_against_plain_edits():
    rng = random.Random(13)
    for size in (1, 2, 31, 63, 64, 65, 130):
        for _ in range(12):
            item = "".join(rng.choice("abcé") for _ in range(size))
            text = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 40))) + edit(rng, item + "a", 3)
            assert D.align(D.points(item), D.points(text), 0, len(text)) == plain.edits(item, text)
