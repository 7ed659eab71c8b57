"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join on the node, both of which Spark splits when
one node is hot; the edges shrink towards one star per component and never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.base import stage


def _star(links: DataFrame, keep: str) -> DataFrame:
    """Hang the neighbours of every node on the least of them (or on the node). ``keep`` filters what moves."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("u") == F.col("k")).filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (long columns ``a``, ``b``); the root is the component's least node.
    Loops, repeats and either direction are allowed; an empty table gives an empty result."""
    state = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(_star(both, "v > u AND v <> m").distinct())
        # Downward links: the lower neighbours go on the least one, and so does the node itself.
        hung = _star(large, "v <> m").unionByName(large.groupBy("u").agg(F.min("v").alias("v")))
        state = stage(hung.distinct())
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
