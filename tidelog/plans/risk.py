"""Risk verdict per document: narrowed prose, then changed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import audits, corpus


def risk_scan(documents: DataFrame, paths: DataFrame, unresolved: DataFrame) -> DataFrame:
    """``doc_id, hits, paths, verdict``. A hit in prose or paths wins over a change list that could
    not be read (``unresolved``: ``doc_id``), which wins over clean.

    The number of risky paths and the first of them stand for the list, which has no bound."""
    terms = corpus.risk_terms(corpus.narrow_scope(documents))
    risky = audits.risky_paths(paths).groupBy("doc_id").agg(
        F.count("*").alias("risky_paths"), F.min("path").alias("first_path"))
    blind = unresolved.select("doc_id").distinct().withColumn("__blind", F.lit(True))
    joined = terms.join(risky, "doc_id", "left").join(blind, "doc_id", "left")
    hit = (F.size("hits") > 0) | F.col("risky_paths").isNotNull()
    verdict = F.when(hit, "hit").when(F.col("__blind"), "could-not-check").otherwise("clean")
    return joined.select(
        "doc_id", F.array_join("hits", ",").alias("hits"),
        F.coalesce("risky_paths", F.lit(0)).alias("risky_paths"), "first_path",
        verdict.alias("verdict"))
