"""Training samples stay bounded where ids repeat, and models are what plain code makes of the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import language, quality, training
from tidelog.llm.base import QUERIES

SF = "/root/testdata/sf0.001"


def test_an_id_counts_once_however_often_it_repeats(spark):
    rows = [(1, "a", f"text {i}") for i in range(1000)] + [(i, "a" if i % 2 else "b", f"t{i}") for i in range(2, 60)] + [(1, "b", "other")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(6)
    ids = training.sample_per_class(docs.select("doc_id", "lang").distinct(), "lang", 10)
    got = training.one_each(docs, ids, "lang").collect()
    assert len(got) == 20 and len({(r["lang"], r["doc_id"]) for r in got}) == 20
    least = docs.filter("doc_id = 1 AND lang = 'a'").orderBy(F.xxhash64("text")).first()["text"]
    assert all(r["text"] == least for r in got if r["doc_id"] == 1 and r["lang"] == "a")


def test_models_of_a_table_and_of_the_table_many_times_are_equal(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    many, named = docs, labels
    for _ in range(3):
        many, named = many.unionByName(docs), named.unionByName(labels)
    one, two = quality.train(docs, labels, per_class=40), quality.train(many, named, per_class=40)
    assert one.good == two.good and one.bad == two.bad and np.allclose(one.weights, two.weights)
    a, b = language.learn(docs, per_class=40), language.learn(many, per_class=40)
    texts = [r["text"] for r in docs.collect()]
    assert [a.predict(t) for t in texts] == [b.predict(t) for t in texts]


def test_predictions_are_those_of_the_fitted_model(spark):
    """The registered queries against the model applied row by row to the whole table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    model = language.learn(docs.filter(~training.held_out(F.col("doc_id"), language.FOLDS, language.FOLD)))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op8_language"](spark, SF).collect()}
    assert got == {r["doc_id"]: model.predict(r["text"]) for r in rows}
    scored = {r["doc_id"]: r for r in QUERIES["op9_quality"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judge = quality.learn(docs, labels)
    for r in rows:
        assert scored[r["doc_id"]]["score"] == pytest.approx(judge.score(None if r["text"] is None else r["text"].encode()), abs=1e-12)
        assert scored[r["doc_id"]]["predicted"] == int(scored[r["doc_id"]]["score"] >= 0.3)
