"""Set operations: partition proofs, evidence unions and inventory differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_audit(parts: DataFrame, inventory: DataFrame, shards: DataFrame) -> DataFrame:
    """Proof that shards are disjoint, free of duplicates and cover the inventory.

    ``parts``: ``shard, item``; ``inventory``: ``item``; ``shards``: every expected ``shard``.
    Returns one row per violation: ``missing``, ``extra``, ``overlap``, ``duplicate``, ``empty``.
    One grouped pass over both sides counts what four set operations would compute."""
    marked = parts.select("item", "shard", F.lit(1).alias("p"), F.lit(0).alias("i")).unionByName(
        inventory.select(
            "item", F.lit(None).cast(parts.schema["shard"].dataType).alias("shard"),
            F.lit(0).alias("p"), F.lit(1).alias("i"))
    )
    per_shard = marked.groupBy("item", "shard").agg(F.sum("p").alias("p"), F.sum("i").alias("i"))
    items = per_shard.groupBy("item").agg(
        F.sum("p").alias("rows"),
        F.sum("i").alias("listed"),
        F.sum((F.col("p") > 0).cast("int")).alias("shards"),
        F.max("p").alias("most"),
    )
    kinds = F.array_compact(F.array(
        F.when((F.col("listed") > 0) & (F.col("rows") == 0), "missing"),
        F.when((F.col("listed") == 0) & (F.col("rows") > 0), "extra"),
        F.when(F.col("shards") > 1, "overlap"),
        F.when(F.col("most") > 1, "duplicate"),
    ))
    bad = items.select(F.explode(kinds).alias("violation"), F.col("item").cast("string").alias("subject"))
    empty = shards.join(parts.select("shard"), "shard", "left_anti").select(
        F.lit("empty").alias("violation"), F.col("shard").cast("string").alias("subject")
    )
    return bad.unionByName(empty)


def merge_evidence(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct evidence of an earlier and a later pass; nothing kept is lost."""
    return kept.unionByName(new).distinct()


def landed_union(main: DataFrame, others: DataFrame, label: str = "(main)") -> DataFrame:
    """Landed rows of the main home and of the other homes with their origin."""
    own = main.withColumn("home", F.lit(label)).withColumn("origin", F.lit("main"))
    return own.unionByName(others.withColumn("origin", F.lit("home")))


def inventory_diff(declared: DataFrame, tracked: DataFrame) -> DataFrame:
    """Items tracked but not declared (``missing``) and declared but not tracked (``extra``)."""
    d, t = declared.select("item").distinct(), tracked.select("item").distinct()
    return t.join(d, "item", "left_anti").withColumn("kind", F.lit("missing")).unionByName(
        d.join(t, "item", "left_anti").withColumn("kind", F.lit("extra"))
    )
