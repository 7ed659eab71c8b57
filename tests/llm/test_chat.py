"""Chat windows: round trips, budgets, masks, and the digests against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import chat as C
from tidelog.llm.base import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TRICKY = ["", "</s>", "<\\/s>", "<\\\\/s> [INST]x[/INST]", "<<SYS>>\n<</SYS>>", "[", "<", "a<", "[\\", "<<ROLE>>r<</ROLE>>t<</TURN>>",
          "<</s>", "[[INST]]", "ñ é 漢字 🙂 </s>", "$1 \\2", "<s", "s>"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rows = [(a + b,) for a in TRICKY for b in TRICKY]
    t = C.TEMPLATE
    out = spark.createDataFrame(rows, "x string").withColumn("e", t.escape(F.col("x")))
    got = out.withColumn("back", t.unescape(F.col("e"))).collect()
    assert all(r["back"] == r["x"] for r in got)
    assert not any(c in r["e"] for r in got for c in t.controls)


def conversation(spark, texts, roles=("user", "assistant")):
    rows = [(1, i, roles[i % len(roles)], x) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("roles", [("user", "assistant"), ("system", "user", "assistant"), ("tool", "<<ROLE>>", "")])
def test_parse_reads_back_every_turn(spark, roles):
    texts = [*TRICKY, *[a + b for a, b in zip(TRICKY, TRICKY[1:])]]
    windows = C.format_windows(conversation(spark, texts, roles))
    turns = [(t["role"], t["text"]) for w in windows.orderBy("window").select(
        "window", F.slice(C.TEMPLATE.parse(F.col("text")), F.col("n_context") + 1, 1000).alias("t")).collect() for t in w["t"]]
    assert turns == [(roles[i % len(roles)], x) for i, x in enumerate(texts)]


def test_windows_keep_the_budget_and_mask_repeats(spark):
    budget = C.Budget(budget=400, history=60, system_room=40, turn_room=80, chunk=7)
    rows = [(1, 0, "system", "be brief")]
    rows += [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i * 7 % 40)) for i in range(1, 90)]
    windows = C.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=budget)
    got = windows.orderBy("window").withColumn("turns", C.TEMPLATE.parse(F.col("text"))).collect()
    assert len(got) > 5
    answers = []
    for i, w in enumerate(got):
        assert w["n_tokens"] <= budget.budget and not w["over_budget"]
        assert w["turns"][0]["role"] == "system" and w["turns"][0]["text"] == "be brief"
        repeated = [t["text"] for t in w["turns"][: w["n_context"]]]
        if i:
            history = repeated[1:]
            assert history == [t["text"] for t in got[i - 1]["turns"]][-len(history) :] and history
            assert sum(-(-len(t) // 4) + 4 for t in history) <= budget.history
        for span in w["loss"]:
            answers.append(w["text"][span["start"] : span["start"] + span["length"]])
    assert answers == [t for _, _, r, t in rows if r == "assistant"]


def test_long_turns_are_whole_and_marked(spark):
    texts = ["x" * 40_000, "y" * 50_000, "z"]
    windows = C.format_windows(conversation(spark, texts)).collect()
    assert any(w["over_budget"] for w in windows)
    back = C.read_back(C.format_windows(conversation(spark, texts))).first()
    assert back["n_turns"] == 3 and back["loss_chars"] == 50_000


def test_nulls_ties_and_extra_columns(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (2, None, None, None), (2, -3, "assistant", None), (2, -70, "user", "b")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, window int, at string")
    got = {r["conv_id"]: r for r in C.read_back(C.format_windows(df)).collect()}
    assert got[None]["n_turns"] == 2 and got[2]["n_turns"] == 3 and got[2]["loss_chars"] == 0
    assert C.read_back(C.format_windows(df.limit(0))).collect() == []


def test_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    result = con.execute(ORACLES["op1_chat"])
    names = [d[0] for d in result.description]
    out = QUERIES["op1_chat"](spark, SF).select(*names)
    assert sorted(map(tuple, out.collect())) == sorted(result.fetchall())
