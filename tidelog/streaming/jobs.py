"""Streaming jobs: incremental folds, idempotent drains and ledgers.

Batches are written to ``<path>/batch_id=<n>`` with overwrite, and ledgers are read up to the
batch before. A batch that is run again after a lost executor or driver replaces its own output
and sees the ledger as it was, so every job is safe to repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import folds, joins, lineage, ordered
from tidelog.sources import ledgers
from tidelog.streaming import keyed, rules
from tidelog.streaming.buckets import BucketLedger
from tidelog.vocab import DEFAULT_THRESHOLDS, DEFAULT_VOCABULARY, OPEN_VERBS, Vocabulary

BatchFn = Callable[[DataFrame, int], None]
#: Buckets of a ledger where the caller names no other number.
BUCKETS = 64
#: Buckets of the states of reply ledgers: 100 million tokens are some 100,000 a bucket.
REPLY_BUCKETS = 1024


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared folder."""
    return f"{lineage.shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_before(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame | None:
    """Rows written by earlier batches, or None when there are none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return df if batch_id is None else df.filter(F.col("batch_id") < batch_id)


# --- folds -----------------------------------------------------------------------------------


def stream_open_decisions(lines: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Incremental open set: the last transition per task and key with ``is_open``.

    State is one row per key and never expires, so a buried decision is never lost. Each trigger
    reads only new lines, combines them before the shuffle and emits the keys that moved; a closed
    key comes out with ``is_open`` false. A changed fold needs a new checkpoint folder."""
    closers = (vocab.resolved, vocab.held)
    moves = lines.filter(
        F.col("key").isNotNull() & F.col("verb").isin(*OPEN_VERBS, *closers)
        & tx.transition_allowed(F.col("key"), F.col("note"), vocab.reserved_prefixes))
    last = F.max_by(F.struct("seq", "verb", "note"), F.col("seq")).alias("m")
    return moves.groupBy("task", "key").agg(last).select(
        "task", "key", "m.seq", "m.verb", "m.note",
        F.col("m.verb").isin(*OPEN_VERBS).alias("is_open"))


def _open_ledger(path: str, kind: str, buckets: int = BUCKETS) -> BucketLedger:
    return BucketLedger(path, ["task", "key"], f"task {kind}, key string, seq long, verb string, note string", buckets)


def apply_moves(path: str) -> BatchFn:
    """Sink of :func:`stream_open_decisions`: the open set as a ledger, of which a batch rewrites the buckets of the keys
    that moved. A closed key leaves the ledger."""

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        ledger = _open_ledger(path, df.schema["task"].dataType.simpleString())
        moved = lineage.cut(df)
        buckets = ledger.touched(moved)
        old = ledger.read(spark, buckets, batch_id).join(moved.select("task", "key"), ["task", "key"], "left_anti")
        now = old.unionByName(moved.filter("is_open").drop("is_open"))
        ledger.write(now, buckets, batch_id)

    return run


def open_set(spark: SparkSession, path: str, task: str = "long") -> DataFrame:
    """Current open set that the moves left; ``task`` is the type of that column."""
    return _open_ledger(path, task).read(spark)


#: What the fold means. A new number makes every log that was folded under another one start over.
FOLD_VERSION = 1


def fold_logs(
    read: Callable[[DataFrame], DataFrame], path: str, vocab: Vocabulary = DEFAULT_VOCABULARY, version: int = FOLD_VERSION,
    buckets: int = BUCKETS,
) -> BatchFn:
    """Open sets of logs that may also shrink, be replaced, or fail to be read.

    Batch rows are looks at logs: ``task, look, ident, size``, the newest ``look`` of a log counts. ``ident`` tells one
    file from another under the same name (null: the look failed), ``size`` counts its lines. ``read`` gets ``task, ident,
    past, size`` of the logs that have something new and gives ``task, seq, verb, key, note`` of the lines past ``past`` and
    up to ``size``. A cursor per log holds fold version, identity and size; where version or identity differ, or the log is
    shorter than the cursor, the log is folded from its first line and its old set dropped, else from the cursor. A log
    whose look failed, or of which other than the wanted number of lines came, keeps set and cursor."""
    cursor_schema = "version int, ident string, size long"

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        kind = df.schema["task"].dataType.simpleString()
        cursors = BucketLedger(f"{path}/cursors", ["task"], f"task {kind}, {cursor_schema}", buckets)
        sets = BucketLedger(f"{path}/sets", ["task"], f"task {kind}, key string, seq long, verb string, note string", buckets)
        newest = F.max_by(F.struct("ident", "size"), "look").alias("n")
        looks = lineage.cut(df.groupBy("task").agg(newest).select("task", "n.ident", "n.size").filter("ident IS NOT NULL"))
        touched = cursors.touched(looks)
        known = cursors.read(spark, touched, batch_id)
        old = known.select("task", F.col("version").alias("__v"), F.col("ident").alias("__i"), F.col("size").alias("__s"))
        met = looks.join(old, "task", "left")
        same = F.coalesce((F.col("__v") == version) & (F.col("__i") == F.col("ident")) & (F.col("__s") <= F.col("size")), F.lit(False))
        past = F.when(same, F.col("__s")).otherwise(F.lit(0).cast("long"))
        plan = lineage.cut(met.filter(~(same & (F.col("__s") == F.col("size")))).select("task", "ident", past.alias("past"), "size"))
        lines = lineage.cut(read(plan.filter("past < size")).select("task", "seq", "verb", "key", "note"))
        came = lines.groupBy("task").agg(F.count("*").alias("came"))
        whole = lineage.cut(plan.join(came, "task", "left").filter(F.coalesce("came", F.lit(0)) == F.col("size") - F.col("past")))
        moves = ordered.latest(folds.decision_moves(lines.join(whole.select("task"), "task", "left_semi"), vocab), ["task", "key"], "seq",
                               ["seq", "verb", "note"])
        moves = lineage.cut(moves)
        before = sets.read(spark, touched, batch_id)
        again = whole.filter("past = 0").select("task")
        kept = before.join(again, "task", "left_anti").join(moves.select("task", "key"), ["task", "key"], "left_anti")
        sets.write(kept.unionByName(moves.filter(F.col("verb").isin(*OPEN_VERBS)).select(*kept.columns)), touched, batch_id)
        held = known.join(whole.select("task"), "task", "left_anti")
        ahead = whole.select("task", F.lit(version).alias("version"), "ident", "size")
        cursors.write(held.unionByName(ahead), touched, batch_id)

    return run


def folded_set(spark: SparkSession, path: str, task: str = "long", buckets: int = BUCKETS) -> DataFrame:
    """Open decisions that :func:`fold_logs` trusts now."""
    return BucketLedger(f"{path}/sets", ["task"], f"task {task}, key string, seq long, verb string, note string", buckets).read(spark)


# --- queue and ledgers -----------------------------------------------------------------------


def drain_wakes(sink: str, annotate: BatchFn | None = None) -> BatchFn:
    """At-least-once drain: deduplicate the batch, write it, then annotate as a best effort."""

    def run(df: DataFrame, batch_id: int) -> None:
        write_batch(folds.dedupe_wakes(df), sink, batch_id)
        if annotate is not None:
            try:
                annotate(df.sparkSession.read.parquet(f"{sink}/batch_id={batch_id}"), batch_id)
            except Exception:  # noqa: BLE001 - the drained rows stand whatever annotation does
                pass

    return run


def offer_once(requests: DataFrame, ttl: int = 7 * 86400, delay: str = "0 seconds") -> DataFrame:
    """A request id wakes once in ``ttl`` seconds, even after its inbox row is gone. Rows: ``request, ts, seq``. Every row
    comes out, as ``offer``, as ``repeat`` of an offer less than ``ttl`` away, or as ``late`` where the state that could
    tell has gone: more than ``delay`` behind the newest row and its offers forgotten."""
    return keyed.stream(requests, "request", rules.OfferOnce(ttl), delay, hold=False)


def consume_events(rules_of: Mapping[str, Column], out: str, buckets: int = BUCKETS) -> BatchFn:
    """Terminal events: each id accepted once, refusals kept with their reason. Ids consumed by an
    earlier batch are dropped; accepted repeats inside a batch count once, refusals all stand. The ledger of consumed ids
    is in buckets: a batch reads and rewrites those of its own ids."""
    ledger = BucketLedger(f"{out}/ledger", ["event_id"], "event_id string", buckets)

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        touched = ledger.touched(df)
        done = ledger.read(spark, touched, batch_id)
        accepted, rejected = ledgers.split_quarantine(df, rules_of, done)
        # Rows are judged before repeats go, so a bad row never hides a good one of the same id.
        write_batch(rejected, f"{out}/rejected", batch_id)
        write_batch(accepted.dropDuplicates(["event_id"]), f"{out}/accepted", batch_id)
        new = spark.read.parquet(f"{out}/accepted/batch_id={batch_id}").select("event_id")
        ledger.write(done.unionByName(new), touched, batch_id)

    return run


def reannounce(out: str, buckets: int = BUCKETS) -> BatchFn:
    """On every trigger announce the captured results that have no handled mark; only the mark ends it.

    Batch rows: ``source, seq, path, kind`` (``result`` or ``handled``), in any order: a mark may come before its result.
    The ledger holds one row per result, ``pending`` or not; a trigger rewrites the buckets of its own rows, and reads all
    pending ones, since it announces them."""

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        source = df.schema["source"].dataType.simpleString()
        columns = f"source {source}, seq long, path string"
        pending = BucketLedger(f"{out}/pending", ["source", "seq"], columns, buckets)
        ended = BucketLedger(f"{out}/ended", ["source", "seq"], f"source {source}, seq long", buckets)
        touched = pending.touched(df)
        marks = ended.read(spark, touched, batch_id).unionByName(df.filter("kind = 'handled'").select("source", "seq")).distinct()
        found = pending.read(spark, touched, batch_id).unionByName(df.filter("kind = 'result'").select("source", "seq", "path"))
        pending.write(joins.pending_results(found.dropDuplicates(["source", "seq"]), marks), touched, batch_id)
        ended.write(marks, touched, batch_id)
        write_batch(pending.read(spark), f"{out}/announced", batch_id)

    return run


def catch_all_sweep(
    logs: DataFrame, surfaced: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Relevant last lines that no earlier path surfaced; run on a trigger of ``sweep_secs``."""
    last = folds.latest_event(logs, ["verb", "line"])
    return joins.unsurfaced(last.filter(tx.is_relevant(F.col("verb"), F.col("line"), vocab)), surfaced)


def timed_sweep(
    read: Callable[[SparkSession, int], DataFrame], out: str, every: int = DEFAULT_THRESHOLDS.sweep_secs,
    vocab: Vocabulary = DEFAULT_VOCABULARY, buckets: int = BUCKETS,
) -> BatchFn:
    """The catch-all sweep as a job: batch rows are ticks with ``now`` in seconds. When ``every`` seconds have passed since
    the last sweep, the logs are read (``read(spark, now)``: ``task, seq, verb, line``) and the relevant last lines that no
    sweep has surfaced yet are written below ``out`` as ``at, task, seq, line``. The stamp of the last sweep and the line
    last surfaced per task are ledgers, so a repeated batch surfaces the same lines, and the next one is silent on them."""
    stamp = BucketLedger(f"{out}/stamp", ["id"], "id int, at long", 1)

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        now = df.agg(F.max("now")).first()[0]
        last = stamp.read(spark, before=batch_id).first()
        if now is None or (last is not None and now - last["at"] < every):
            return
        logs = read(spark, now)
        seen = BucketLedger(f"{out}/seen", ["task"], f"task {logs.schema['task'].dataType.simpleString()}, line string", buckets)
        found = lineage.cut(catch_all_sweep(logs, seen.read(spark, before=batch_id), vocab).select("task", "seq", "line"))
        write_batch(found.select(F.lit(now).cast("long").alias("at"), "*"), f"{out}/surfaced", batch_id)
        touched = seen.touched(found)
        kept = seen.read(spark, touched, batch_id).join(found.select("task"), "task", "left_anti")
        seen.write(kept.unionByName(found.select("task", "line")), touched, batch_id)
        stamp.write(spark.createDataFrame([(0, now)], "id int, at long"), [0], batch_id)

    return run


# --- rules with timers -----------------------------------------------------------------------


# With ``delay`` rows are held until the newest one is that far ahead, and taken in order of time; without it they are taken
# as they come, and those behind their key's place come out as ``late``.


def coalesce_signals(changes: DataFrame, key: str = "home", delay: str | None = None, **kw) -> DataFrame:
    return keyed.stream(changes, key, rules.CoalesceSignals(**kw), delay)


def batch_escalations(items: DataFrame, key: str = "channel", delay: str | None = None, **kw) -> DataFrame:
    return keyed.stream(items, key, rules.BatchEscalations(**kw), delay)


def stream_timers(rows: DataFrame, key: str = "entity", delay: str | None = None, **kw) -> DataFrame:
    return keyed.stream(rows, key, rules.Timers(**kw), delay)


def stream_alert_edges(rows: DataFrame, mode: str, key: str = "entity", delay: str | None = None) -> DataFrame:
    return keyed.stream(rows, key, rules.AlertEdges(mode), delay)


def stream_busy_state(rows: DataFrame, key: str = "task", delay: str | None = None) -> DataFrame:
    return keyed.stream(rows, key, rules.BusyState(), delay)


def stream_replies(
    rows: DataFrame, key: str = "corr", delay: str | None = None, buckets: int | None = REPLY_BUCKETS, **kw,
) -> DataFrame:
    """Tokens are very many and have a few rows each, so their states are kept by bucket."""
    return keyed.stream(rows, key, rules.Replies(**kw), delay, buckets=buckets)


# --- running to the end ----------------------------------------------------------------------


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is available now and return everything written."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(lambda df, n: write_batch(df, f"{path}/out", n))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch_id")


def run_batches(stream: DataFrame, fn: BatchFn, path: str, mode: str = "append") -> None:
    """Process what is available now through a batch function."""
    (
        stream.writeStream.outputMode(mode).foreachBatch(fn)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
