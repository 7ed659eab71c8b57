"""From raw documents to a training mix: quality, repeated lines, near copies, benchmark leaks, source weights.

Every stage takes the documents that the one before it kept, as a table, and returns documents. The last repeats each
document as often as the mix takes it and numbers the repeats in ``copy``.

Nulls and odd cases follow the operators: null and empty texts are scored as such, have no lines, are near
copies of each other, hold no benchmark item and have size 0 (so the mix takes none of them). Rows that repeat, with or
without an id, are near copies of each other, and one stays; a row without an id stays only where no row with one is in
its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, lines, mixing, near, quality
from tidelog.llm.base import stage, table, word_count


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at its threshold or better."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.filter(F.col("__quality_score") >= quality.THRESHOLD).drop("__quality_score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that equal or resemble an earlier one."""
    return lines.dedup_lines(docs, counts=False).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more, as SimHash fingerprints
    find it, and MinHash bands where these are too far apart: that of least id (nulls last), then of least text hash, then of least hash of all columns; of rows equal in all columns, any one."""
    linked = near.group_documents(docs)
    counted = linked.groupBy("group", "doc_id", "mark", "row").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "row", "n")
    chosen = stage(counted.groupBy("group").agg(F.min(order).alias("one")).select("one.row", "one.mark", "one.n"))
    return near.take_rows(docs, chosen)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the given columns, and ``copy`` from 1 (in place of a column of that
    name). Rows equal in all columns share
    one numbering, over the copies of them all."""
    hashed = docs.select("doc_id", "source", "text", near.row_hash(docs).alias("__row"), F.xxhash64("text").alias("__mark"))
    mixed = mixing.mix(hashed, word_count(F.col("text")), key=["__row", "__mark"])
    taken = mixed.groupBy(F.col("__row").alias("row"), F.col("__mark").alias("mark")).agg(
        F.count("*").alias("n"), F.sum("copies").alias("__copies")
    )
    met = near.take_rows(docs, stage(taken.filter("__copies > 0")))
    kept = [c for c in docs.columns if c != "copy"]
    return met.select(*kept, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
]

#: Learned scores, fingerprints by majority and balanced rates are not said in SQL; the tests compare brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
