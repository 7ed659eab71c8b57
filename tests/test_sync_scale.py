"""Joins of inventories whose size Spark guesses too low."""

from pyspark.sql import functions as F

from tidelog.operators import joins


def test_no_side_of_a_sync_is_gathered_on_the_driver(spark):
    primary = spark.range(50).select(F.col("id").alias("item"), F.lit("a").alias("digest"))
    replica = spark.range(50).filter("id % 2 = 0").select(F.lit(1).alias("target"), F.col("id").alias("item"), F.lit("a").alias("digest"))
    rules = spark.range(60).select(
        F.lit(1).alias("target"), F.col("id").alias("item"), F.lit(False).alias("session_scoped"), F.lit(True).alias("allowed"))
    found = joins.sync_diff(primary, replica, rules)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    counts = {r["action"]: r["count"] for r in found.groupBy("action").count().collect()}
    assert counts == {"unchanged": 35, "pushed": 25}
