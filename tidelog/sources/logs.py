"""Line-ordered text sources and key=value records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators import ordered


def read_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every line of every file with its number: ``file, line_no, line``.

    Files stay splittable. Within one split the reader emits lines in file order, and ids rise
    along a partition, so the start of the split plus the position inside it orders a whole file;
    the line counts of the earlier splits (one row each) turn this into a line number.
    """
    reader = spark.read
    for name, value in options.items():
        reader = reader.option(name, value)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
    )
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    return raw.join(starts, ["file", "block"]).select(
        "file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "line"
    )


def _task_of(file: Column) -> Column:
    """The task a file name stands for; a plus sign is no blank here."""
    stem = F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.coalesce(F.try_url_decode(F.regexp_replace(stem, r"\+", "%2B")), stem)


def read_status_logs(spark: SparkSession, path: str) -> DataFrame:
    """Status logs, one file per task: ``task, seq, line``; blank lines are dropped after
    numbering, so ``seq`` is the line's place in its file."""
    return read_lines(spark, path, pathGlobFilter="*.status").filter(
        F.col("line").rlike(r"\S")
    ).select(_task_of(F.col("file")).alias("task"), F.col("line_no").alias("seq"), "line")


def read_kv(spark: SparkSession, path: str, glob: str = "*.meta") -> DataFrame:
    """``key=value`` files as a long table ``task, seq, k, v``."""
    at = F.instr("line", "=")
    return read_lines(spark, path, pathGlobFilter=glob).filter(at > 1).select(
        _task_of(F.col("file")).alias("task"),
        F.col("line_no").alias("seq"),
        F.substring(F.col("line"), F.lit(1), at - 1).alias("k"),
        F.substring(F.col("line"), at + 1, F.length("line")).alias("v"),
    )


def pivot_kv(df: DataFrame, fields: list[str], policy: str = "last") -> DataFrame:
    """One row per task with a column per field. ``last``: the last line wins; ``exactly_one``: two
    lines for a field are no value."""
    kept = df.filter(F.col("k").isin(*fields))
    if policy == "last":
        cells = ordered.latest(kept, ["task", "k"], "seq", ["v"])
    elif policy == "exactly_one":
        cells = kept.groupBy("task", "k").agg(
            F.when(F.count("*") == 1, F.max("v")).alias("v"))
    else:
        raise ValueError(f"unknown policy: {policy}")
    columns = [F.max(F.when(F.col("k") == f, F.col("v"))).alias(f) for f in fields]
    return cells.groupBy("task").agg(*columns)
