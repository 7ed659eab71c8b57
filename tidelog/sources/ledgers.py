"""Queues, append-once targets, quarantine, continuity, timings and snapshot export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import digests
from tidelog.functions import text as tx
from tidelog.operators import ordered
from tidelog.vocab import WAKE_KINDS


def number_wakes(df: DataFrame, order: str, base: Column | int = 0) -> DataFrame:
    """Wakes ready to append: unknown kinds refused, fields scrubbed, ``seq`` rising from ``base``
    in the given order. ``df``: ``epoch, kind, key, payload`` and the order column."""
    known = df.filter(F.col("kind").isin(*WAKE_KINDS))
    start = F.lit(base) if isinstance(base, int) else base
    return ordered.rank(known, [], order, "__n").select(
        "epoch", (start + F.col("__n")).cast("long").alias("seq"), "kind",
        tx.clean_text(F.col("key")).alias("key"),
        tx.clean_text(F.col("payload")).alias("payload"),
    )


def append_wakes(df: DataFrame, order: str, path: str) -> None:
    """Append to the queue table at ``path``, continuing its counter."""
    spark = df.sparkSession
    base = 0
    if _exists(spark, path):
        base = spark.read.parquet(path).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    number_wakes(df, order, base).write.mode("append").parquet(path)


def new_lines(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` not yet in ``target``, each once."""
    return df.dropDuplicates(list(keys)).join(target.select(*keys).distinct(), list(keys), "left_anti")


def append_once(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append rows whose keys are not present byte for byte. A failed append leaves the target as
    it was and running it again appends what is missing."""
    spark = df.sparkSession
    fresh = new_lines(df, spark.read.parquet(path), keys) if _exists(spark, path) else df.dropDuplicates(list(keys))
    fresh.write.mode("append").parquet(path)


def split_quarantine(
    df: DataFrame, rules: Mapping[str, Column], consumed: DataFrame, key: str = "event_id"
) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with the ``reason`` of the first failing rule. Keys already
    consumed are dropped silently. ``rules`` maps a reason to the condition that rejects; a
    condition that is unknown rejects as well."""
    fresh = df.join(consumed.select(key), key, "left_anti")
    reason = F.lit(None).cast("string")
    for text, rejects in reversed(rules.items()):
        reason = F.when(F.coalesce(rejects, F.lit(True)), text).otherwise(reason)
    judged = fresh.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


EVENT_ID_FIELDS = (
    "obligation_id", "relation_id", "source_home_id", "work_id", "generation", "outcome_type",
    "deliverables",
)


def event_rules(max_bytes: int = 8192) -> dict[str, Column]:
    """Rules for terminal events, in order. Rows: ``event_id, declared_id, bytes, payload`` and the
    identity fields."""
    slug = "^[A-Za-z0-9_-][A-Za-z0-9._-]*$"
    derived = tx.derive_event_id(*[F.col(c) for c in EVENT_ID_FIELDS])
    return {
        "unsafe event name": ~F.col("event_id").rlike(slug),
        f"event exceeds {max_bytes} bytes": F.col("bytes") > max_bytes,
        "event is not valid JSON": F.try_parse_json("payload").isNull(),
        "declared event_id does not match the name": F.col("declared_id") != F.col("event_id"),
        "event id does not match its own identity fields": derived != F.col("event_id"),
        "unsafe obligation id in event": ~F.col("obligation_id").rlike(slug),
    }


# --- continuity ------------------------------------------------------------------------------


def log_digest(df: DataFrame) -> DataFrame:
    """Per log: ``lines, bytes, digest`` of its whole content. Position is part of every hashed
    element, so the digest fixes the order although it is an order-free sum."""
    lanes = [f"__l{i}" for i in range(digests.LANES)]
    placed = F.concat_ws("\u001f", F.col("seq").cast("string"), F.col("line"))
    words = digests.element_lanes(placed)
    rows = df.select(
        "log", (F.octet_length("line") + 1).cast("long").alias("size"),
        *[w.alias(n) for w, n in zip(words, lanes, strict=True)])
    return rows.groupBy("log").agg(
        F.count("*").alias("lines"), F.sum("size").alias("bytes"),
        digests.digest_of([F.col(n) for n in lanes], F.count("*")).alias("digest"))


def audit_continuity(cursors: DataFrame, new: DataFrame, max_bytes: int, **kw) -> DataFrame:
    """Compare a log with the cursor an earlier reader left behind.

    ``cursors``: ``log, lines, bytes, digest`` from :func:`log_digest`; ``new``: ``log, seq, line``
    with ``seq`` 1, 2, 3 … within a log. Status per log: ``missing``, ``truncated``,
    ``prefix-changed``, ``delta`` (whole lines only, at most ``max_bytes``),
    ``line-exceeds-bound`` or ``unchanged``, with the lines and bytes the delta carries."""
    at = cursors.select("log", F.col("lines").alias("at"), F.col("bytes").alias("at_bytes"), "digest")
    joined = new.join(at, "log")
    prefix = log_digest(joined.filter(F.col("seq") <= F.col("at"))).select(
        "log", F.col("digest").alias("now_digest"))
    size = (F.octet_length("line") + 1).cast("long")
    totals = new.groupBy("log").agg(F.sum(size).alias("now_bytes"))
    beyond = joined.filter(F.col("seq") > F.col("at")).withColumn("size", size)
    running = ordered.scan(beyond, ["log"], "seq", total={"upto": F.col("size")}, **kw)
    delta = running.groupBy("log").agg(
        F.count(F.when(F.col("upto") <= max_bytes, 1)).alias("delta_lines"),
        F.max(F.when(F.col("upto") <= max_bytes, F.col("upto"))).alias("delta_bytes"))
    empty = F.col("at") == 0
    status = (
        F.when(F.col("now_bytes").isNull(), F.when(empty, "unchanged").otherwise("missing"))
        .when(F.col("now_bytes") < F.col("at_bytes"), "truncated")
        .when(~empty & ~F.col("digest").eqNullSafe(F.col("now_digest")), "prefix-changed")
        .when(F.col("now_bytes") == F.col("at_bytes"), "unchanged")
        .when(F.coalesce("delta_lines", F.lit(0)) > 0, "delta")
        .otherwise("line-exceeds-bound")
    )
    carried = F.col("status") == "delta"
    return (
        at.join(totals, "log", "left").join(prefix, "log", "left").join(delta, "log", "left")
        .withColumn("status", status)
        .select("log", "status",
                F.when(carried, F.col("delta_lines")).otherwise(0).alias("delta_lines"),
                F.when(carried, F.col("delta_bytes")).otherwise(0).alias("delta_bytes"))
    )


# --- timings and snapshots -------------------------------------------------------------------

TIMING_SCHEMA = (
    "run_id string, selection string, started_at string, finished_at string, "
    "summary struct<total: long, failed: long, skipped_gate: long, duration_ms: long>, "
    "scripts array<struct<path: string, family: string, expected_gate_skip: string, "
    "duration_ms: long, `exit`: long, gate_skip: boolean>>"
)


def read_timings(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Lanes and scripts of timing artifacts: one JSON document per file, or per line."""
    docs = spark.read.schema(TIMING_SCHEMA).json(path, multiLine=multi_line)
    lanes = docs.select("run_id", "selection", "started_at", "finished_at", "summary.*")
    scripts = docs.select(
        F.col("selection").alias("lane"), F.col("run_id"), F.inline("scripts"))
    return lanes, scripts


def write_timings(lanes: DataFrame, scripts: DataFrame, path: str) -> None:
    """Aggregate artifact as JSON lines: lanes and scripts under one folder."""
    lanes.write.mode("overwrite").json(f"{path}/lanes")
    scripts.write.mode("overwrite").json(f"{path}/scripts")


def write_snapshot(sections: Mapping[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Every section as a table; ``form="json"`` writes one document per row instead."""
    for name, df in sections.items():
        out = df if form == "parquet" else df.select(F.to_json(F.struct(*df.columns)).alias("value"))
        writer = out.write.mode("overwrite")
        writer.parquet(f"{path}/{name}") if form == "parquet" else writer.text(f"{path}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True
