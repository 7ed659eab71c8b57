"""The status logs of the catalog: many logs a file, numbered by the reader."""

import os

from pyspark.sql import functions as F

from tidelog.catalog import source_queries as sq


def folder(spark, tmp_path, logs):
    events = spark.range(4 * logs).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"),
        F.when(F.col("id") % logs != 3, F.col("id") % logs).alias("user_id"),
        F.when(F.col("id") == 7, "a\nb").otherwise("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 12}').alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_files_do_not_grow_with_logs(spark, tmp_path):
    path = sq._write_logs(spark, folder(spark, tmp_path, 300))
    files = [f for _, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".txt")]
    assert 1 <= len(files) <= 8


def test_lines_are_numbered_within_their_log(spark, tmp_path):
    rows = sq.read_status_lines(spark, folder(spark, tmp_path, 50)).collect()
    numbers = {}
    for r in sorted(rows, key=lambda r: r["line_no"]):
        numbers.setdefault(r["task"], []).append(r["line_no"])
    assert set(numbers) == set(range(50)) - {3} | {None}
    assert numbers[7] == [1, 2, 3, 4, 5] and all(v == [1, 2, 3, 4] for k, v in numbers.items() if k != 7)
    assert {r["line"] for r in rows if r["task"] == 9} == {f"needs-decision [key=k0]: click {9 + 50 * i}" for i in range(4)}


def test_metadata_patterns_run_only_where_their_key_is(spark):
    from tidelog.functions import text as tx

    rows = [("a (hold: x)",), ("a (hold-kind: y)",), ("no key",), ("hold: outside",), (None,), ("a (merged 2024-01-02)",)]
    df = spark.createDataFrame(rows, "t string")
    hold, merged = tx.extract_meta(F.col("t"), "hold"), tx.extract_meta_word(F.col("t"), "merged")
    found = df.select("t", hold.alias("h"), tx.extract_meta(F.col("t"), "hold-kind").alias("k"), merged.alias("m"))
    assert "Contains" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[1:] for r in found.collect()] == [
        ("x", None, None), (None, "y", None), (None, None, None), (None, None, None), (None, None, None), (None, None, "2024-01-02")]
