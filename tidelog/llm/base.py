"""Helpers shared by the operators: registration, intermediate tables, words, global ranks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.lineage import shared_base

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

#: A word is a run of anything but the ASCII blanks (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: its lineage ends there, and a lost
    executor costs no recomputation of what went before."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What runs within leaves no shuffle files behind: each execution deletes its own when it ends, where they else stay
    until the driver happens to collect its garbage. For tables that ``stage`` writes; a frame that is returned from
    within and run itself would make its shuffles anew each time."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the position of every row in the total order, from 0, without a single-task sort: range partitions are
    numbered locally, and each adds the row counts of those before it."""
    local = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    local = local.withColumn("__part", F.shiftright("__at", 33))
    counts = local.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row per partition of the range exchange: bounded by the number of shuffle partitions.
    before = counts.select(
        "__part",
        F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("__before"),
    )
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        local.join(F.broadcast(before), "__part")
        .withColumn(name, F.col("__before") + row)
        .drop("__part", "__at", "__before")
    )
