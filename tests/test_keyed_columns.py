"""The keyed runner: rows of a trigger as columns, and states of many keys in one bucket."""

import numpy as np
import pandas as pd
import pytest

from tidelog.streaming import jobs, keyed, rules


def test_rows_are_columns_until_their_turn():
    n = 50_000
    batches = [pd.DataFrame({
        "ts": np.arange(at, at + 10_000)[::-1], "seq": np.arange(at, at + 10_000),
        "kind": [f"kind {i % 3}" for i in range(10_000)], "n": [None if i % 5 == 0 else i for i in range(10_000)],
    }) for at in range(0, n, 10_000)]
    came = keyed._Rows(iter(batches), ["ts", "seq", "kind"])
    assert sum(v.nbytes for v in came.values) <= 24 * n
    assert len({id(v) for v in came.values[2].tolist()}) == 3
    got = came.rows(came.order())
    assert next(got) == {"ts": 0, "seq": 9999, "kind": "kind 0"}
    assert [r["ts"] for r in got] == list(range(1, n))
    nulls = keyed._Rows(iter(batches[:1]), ["ts", "seq", "n"])
    assert [r["n"] for r in nulls.rows(np.arange(3))] == [None, 1, 2]


@pytest.mark.parametrize("delay", [None, "50 seconds"])
def test_buckets_give_what_keys_give(spark, tmp_path, delay):
    kinds = ("request", "idle", "busy", "outcome", "report")
    rows = [(f"c{(7 * i) % 40}" if i % 11 else None, 10 * (i // 2) + i % 2, i, kinds[(i * i + i // 40) % 5], ("failed", "confirmed")[i % 2])
            for i in range(600)]
    schema = "corr string, ts long, seq long, kind string, text string"
    for part in range(5):
        spark.createDataFrame(rows[120 * part : 120 * part + 120], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    results = []
    for name, buckets in (("keys", None), ("buckets", 3)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = jobs.stream_replies(stream, delay=delay, buckets=buckets, grace=120, wait=900)
        assert out.columns == ["corr", "kind", "ts", "seq", "phase", "detail"]
        found = jobs.run_to_table(out, str(tmp_path / name))
        results.append(sorted(map(tuple, found.collect()), key=str))
    assert results[0] == results[1] and {r[1] for r in results[0]} >= {"opened", "resolved", "send"}


def test_reply_ledgers_are_kept_by_bucket(spark, tmp_path):
    stream = spark.readStream.schema("corr string, ts long, seq long, kind string, text string").parquet(str(tmp_path))
    plan = jobs.stream_replies(stream)._jdf.queryExecution().analyzed().toString()
    assert "__bucket" in plan and rules.Replies().grace


