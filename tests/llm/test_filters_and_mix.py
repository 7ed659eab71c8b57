"""URL filters, mixing, digests and classifiers on the small tables and on odd rows."""

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import digest, language, mixing, quality, url_filter
from tidelog.llm.base import ORACLES, QUERIES, word_count

SF = "/root/testdata/sf0.001"
URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "x://example.org/en/1", "x://example.org/en/2",
        "x://notexample.org/es/", "x://a.com/fr/1", "x://com/de/", "x://b.com/de", "x://q.net?utm_source=a", "x://q.net", "y://z/?ref=1",
        "y://z/", "x://É.org/", "x://a\n.org/b\nc"]


def test_urls_against_sql(spark):
    pages = spark.createDataFrame([(i, u, "k", True) for i, u in enumerate(URLS)], "page_id long, url string, key string, listed boolean")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    result = con.execute(ORACLES["op6_url_filter"])
    names = [d[0] for d in result.description]
    out = url_filter.judge(pages)
    assert sorted(out.columns) == sorted(names)
    assert sorted(map(str, out.select(*names).collect())) == sorted(
        "Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, r)) + ")" for r in result.fetchall())
    assert url_filter.judge(pages.limit(0)).collect() == []


@pytest.mark.parametrize("max_words", [1 << 17, 8])
def test_cascade_is_exact(spark, max_words):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys, bits_per_key=4, n_hashes=3, max_words=max_words)
    assert len(cascade.levels) > 2 and (cascade.n_shards > 1) == (max_words == 8)
    got = cascade.mark(keys.withColumnRenamed("listed", "truth"), F.col("key"))
    assert got.filter(F.col("listed") != F.col("truth")).count() == 0 and got.count() == 3000


def test_mix_of_the_table(spark):
    out = QUERIES["op4_mix_sources"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        words = len(r["text"].encode().split()) if r["text"] else 0
        assert r["size"] == words and r["taken"] <= 3 * words and (not words or r["taken"] % words == 0)
        size[r["source"]] += words
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    total, left, want = sum(size.values()), set(size), {}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(size))}
    while True:
        room = total - sum(want.values())
        level = room / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level > 3 * size[s]}
        if not full:
            break
        want |= {s: 3.0 * size[s] for s in full}
        left -= full
    want |= {s: weight[s] * level for s in left}
    for s in size:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert taken[s] == pytest.approx(want[s], rel=0.05)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, QUERIES["op4_mix_sources"](spark, SF).collect()))


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b", None), (2, None, "s"), (None, "x " * 30, "s"), (3, "", "e"), (4, "y " * 5, "t"), (4, "y " * 5, "t"), (5, "z " * 900, "u")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, copies int, rate double")
    got = mixing.mix(docs, word_count(F.col("text"))).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 3 for r in got)
    assert mixing.mix(docs.limit(0), word_count(F.col("text"))).collect() == []


def test_balance_meets_two_margins(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50)], "s string, l string, tokens long")
    by_s = spark.createDataFrame([("a", 300.0), ("b", 300.0)], "s string, target double")
    by_l = spark.createDataFrame([("x", 350.0), ("y", 250.0)], "l string, target double")
    got = mixing.balance(cells, {"s": by_s, "l": by_l}).collect()
    for key, value, want in (("s", "a", 300), ("s", "b", 300), ("l", "x", 350), ("l", "y", 250)):
        assert sum(r["tokens"] * r["rate"] for r in got if r[key] == value) == pytest.approx(want, rel=1e-6)


def test_digests_against_plain_chains(spark):
    out = {r["doc_id"]: r for r in QUERIES["op2_digest"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs), reverse=True)
    for i, (doc, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)], len(text) // 2
        changed = text[: len(text) - half] + after[1][:half]
        own, other, following = (digest.fingerprint(t.encode()) for t in (text, changed, after[1]))
        want = (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other,
                digest.likeness(own, other), digest.likeness(own, following))
        assert tuple(out[doc]) == want
    near = sum(r["near_edited"] > r["near_next"] for r in out.values())
    assert near > 0.9 * len(out)


def test_digests_of_odd_texts(spark):
    assert digest.likeness(digest.fingerprint(b""), digest.fingerprint(b"")) == 1.0
    assert digest.fingerprint(b"ab") == digest.fingerprint(b"xy") != digest.fingerprint(b"")
    big = b"some text over and over " * 40_000
    assert digest.fingerprint(big) == digest.fingerprint(bytes(big))
    rows = [(1, "abc"), (None, "zzzz"), (1, "abd"), (7, None), (None, "y"), (3, ""), (9, "qwertyuiop")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, range int").repartition(4)
    keep = lambda doc, text, following: (doc, text, following)
    got = digest.with_next(docs, keep, "doc_id long, t string, n string").collect()
    assert Counter((r["doc_id"], r["t"]) for r in got) == Counter((i, t or "") for i, t in rows)
    assert Counter(r["n"] for r in got) == Counter(t or "" for _, t in rows)
    one = digest.with_next(docs.filter("doc_id = 9"), keep, "doc_id long, t string, n string").collect()
    assert [(r["t"], r["n"]) for r in one] == [("qwertyuiop", "qwertyuiop")]
    assert digest.with_next(docs.limit(0), keep, "doc_id long, t string, n string").collect() == []


def test_language_of_held_out_rows(spark):
    out = QUERIES["op8_language"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.filter("held_out").join(truth, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.learn(docs)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 ***", 5), (None, "the and of that " * 50_000, 5)], "doc_id long, text string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "en"
    nothing = language.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    three = docs.withColumn("lang", F.when(F.col("lang") == "es", "xx").otherwise(F.col("lang")))
    assert "xx" in language.learn(three).families


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op9_quality"](spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = out.join(truth, "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["predicted"] == 1 for r in good) >= 0.97 * len(good)
    assert sum(r["predicted"] == 0 for r in bad) >= 0.6 * len(bad)
    held = [r for r in rows if r["held_out"]]
    pairs = [(a["score"], b["score"]) for a in held if a["quality"] for b in held if not b["quality"]]
    assert sum((a > b) + (a == b) / 2 for a, b in pairs) >= 0.9 * len(pairs)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "plain words here", 1), (None, "x" * 100_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (2, None), (99, 0), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "__quality_score"]
    assert all(0 <= r["__quality_score"] <= 1 for r in got.collect())
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).collect() == []
