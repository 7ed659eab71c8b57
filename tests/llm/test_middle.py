"""Fill-in-middle: line ends against a regular expression, exact round trips, and SQL on the given table."""

import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import middle
from tidelog.llm.base import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é\n中👍\nq", "12345678\n", "1234567\n8", "x" * 50 + "\n" * 20, "has <P> in\nit",
         "<S>", "a<M>\n", "<S\n>P<\n<", "<\nS>", "\n".join(f"line {i} ü" for i in range(3000)), "\x00\n\x00\n\x00", "\x8a\nĊ\n"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a\n\x00\x0b\x8aé中👍", max_size=90))
def test_line_ends(text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    ends = middle.LineEnds(text.encode())
    assert ends.count == len(units)
    assert [ends.end(k) for k in range(len(units) + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]


def expected(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h1, h2, h3, h4 = middle.draws(doc_id)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (100, 0)])
def test_round_trip(spark, rate, spm):
    rows = [(100 * i + j, t) for i, t in enumerate(TEXTS) for j in range(12)] + [(None, "q\nr"), (None, None), (3, "u\nv"), (3, "u\nv")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, form string").repartition(3)
    out = middle.fill_in_middle(docs, rate=rate, spm_rate=spm).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    got = out.collect()
    want = [(i, *expected(i, t, rate, spm), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({r["form"] for r in got}) == (3 if spm == 50 else 2)


def test_long_text_and_empty_table(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab é\n") for _ in range(700_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(middle.fill_in_middle(docs).first()) == (1, *expected(1, text))
    assert middle.fill_in_middle(docs.limit(0)).collect() == []


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF0A80620A' AS STRING) AS text")
    out = middle.fill_in_middle(docs).select(F.hex(middle.restored(F.col("output"), F.col("form")).cast("binary")).alias("h"))
    assert out.first()["h"] == "61FF0A80620A"


def test_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = con.execute(ORACLES["op12_fill_in_middle"])
    names = [d[0] for d in result.description]
    got = QUERIES["op12_fill_in_middle"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())
