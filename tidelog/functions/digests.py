"""Mergeable digests: exact change detection without gathering a log or a set in one task.

A digest is the sum, per 32-bit lane, of SHA-256 values of its elements, hashed once more. Sums
combine map-side, so a group of any size costs one small row per partition. With the position
inside each element's hash the digest also fixes the order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = 8


def element_lanes(element: Column) -> list[Column]:
    """The eight 32-bit words of SHA-256 as longs."""
    digest = F.sha2(element, 256)
    return [
        F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(LANES)
    ]


def digest_of(lane_columns: list[Column], count: Column) -> Column:
    """Aggregate expression: digest of the grouped elements whose lanes were projected before.

    Lane sums wrap modulo 2**64 only beyond 2**31 elements; decimals keep them exact."""
    sums = [F.sum(c.cast("decimal(38,0)")).cast("string") for c in lane_columns]
    return F.sha2(F.concat_ws(":", count.cast("string"), *sums), 256)
