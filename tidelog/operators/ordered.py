"""Ordered per-key computations that survive one key holding a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(seq)`` sends a whole key to one task. Every rule in
this package that looks back over a log needs only three things from the past: the previous
row, the last value seen so far, or a running total. Each of them splits in two levels:

1. rows are grouped by ``(key, chunk)``, ``chunk`` being the high bits of ``seq``; as ``seq`` is
   unique within a key, no group exceeds ``2 ** chunk_bits`` rows;
2. each chunk is summarised to one row (a map-side-combined aggregate), the summaries are
   scanned per key, and the carry is joined back on ``(key, chunk)``. The big side is already
   partitioned by these columns, so that join adds no second exchange of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 18
_CHUNK = "__chunk"


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    previous: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add columns that depend on the earlier rows of the same key.

    ``previous``: the value on the row just before (null on the first row).
    ``last``: the last non-null value strictly before the row.
    ``total``: the running sum up to and including the row.
    ``order`` names an integer column, unique within a key; keys must not be null.
    """
    previous, last, total = dict(previous or {}), dict(last or {}), dict(total or {})
    src = df.withColumn(_CHUNK, F.shiftright(F.col(order).cast("long"), chunk_bits))
    for name, value in {**previous, **last, **total}.items():
        src = src.withColumn(f"__in_{name}", value)

    tails = []
    # One max_by per column, not one over a struct: fixed-width buffers keep hash aggregation.
    for name in previous:
        tails.append(F.max_by(f"__in_{name}", F.col(order)).alias(f"__tail_{name}"))
    for name in last:
        held = F.col(f"__in_{name}")
        tails.append(F.max_by(held, F.when(held.isNotNull(), F.col(order))).alias(f"__tail_{name}"))
    for name in total:
        tails.append(F.sum(f"__in_{name}").alias(f"__tail_{name}"))

    over_chunks = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    carry = src.groupBy(*keys, _CHUNK).agg(*tails)
    for name in previous:
        carry = carry.withColumn(f"__carry_{name}", F.lag(f"__tail_{name}").over(over_chunks))
    for name in last:
        carry = carry.withColumn(
            f"__carry_{name}", F.last(f"__tail_{name}", ignorenulls=True).over(before)
        )
    for name in total:
        carry = carry.withColumn(f"__carry_{name}", F.sum(f"__tail_{name}").over(before))
    carry = carry.select(
        *keys, _CHUNK, *[c for c in carry.columns if c.startswith("__carry_")]
    )

    within = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = src
    if previous:
        rows = rows.withColumn("__first", F.row_number().over(within) == 1)
    for name in previous:
        rows = rows.withColumn(f"__near_{name}", F.lag(f"__in_{name}").over(within))
    for name in last:
        rows = rows.withColumn(
            f"__near_{name}", F.last(f"__in_{name}", ignorenulls=True).over(earlier)
        )
    for name in total:
        rows = rows.withColumn(f"__near_{name}", F.sum(f"__in_{name}").over(upto))

    rows = rows.join(carry, [*keys, _CHUNK], "left")
    out = [F.col(c) for c in df.columns]
    out += [
        F.when(F.col("__first"), F.col(f"__carry_{n}")).otherwise(F.col(f"__near_{n}")).alias(n)
        for n in previous
    ]
    out += [F.coalesce(f"__near_{n}", f"__carry_{n}").alias(n) for n in last]
    out += [
        (F.coalesce(F.col(f"__near_{n}"), F.lit(0)) + F.coalesce(F.col(f"__carry_{n}"), F.lit(0))).alias(n)
        for n in total
    ]
    return rows.select(*out)


def rank(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "rn",
    *,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Dense 1-based position of each row within its key, by ``order``; ``keys=[]`` ranks globally."""
    return scan(df, keys, order, total={name: F.lit(1).cast("long")}, chunk_bits=chunk_bits)


def latest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Last row per key as a map-side-combined aggregate instead of a window."""
    top = F.max_by(F.struct(*columns), F.col(order)).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in columns])


def earliest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """First row per key as a map-side-combined aggregate."""
    top = F.min_by(F.struct(*columns), F.col(order)).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in columns])
