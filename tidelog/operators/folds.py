"""Folds over keyed logs. Every "last one wins" rule is a map-side-combined ``max_by``.

Log rows carry ``task`` (the log), ``seq`` (position in it) and the parsed ``verb``, ``key`` and
``note``; see :func:`tidelog.functions.text.parse_status`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import digests
from tidelog.functions import text as tx
from tidelog.operators import ordered
from tidelog.vocab import ACTIVITY_CLOSERS, DEFAULT_VOCABULARY, OPEN_VERBS, WAKE_KINDS, Vocabulary


def latest_event(df: DataFrame, columns: Sequence[str] = ("verb", "key", "note", "line")) -> DataFrame:
    """Last non-blank line per log."""
    rows = df.filter(F.col("line").rlike(r"\S"))
    return ordered.latest(rows, ["task"], "seq", ["seq", *columns])


def _last_transition(df: DataFrame, openers: Sequence[str], closers: Sequence[str]) -> DataFrame:
    """Open set of a keyed fold. Replaying a log reduces to the last transition per key: it is
    open when that transition is an opener. Rows that move nothing are filtered before the
    shuffle, and partial aggregation keeps at most one row per key and input partition."""
    moves = df.filter(F.col("key").isNotNull() & F.col("verb").isin(*openers, *closers))
    ends = ordered.latest(moves, ["task", "key"], "seq", ["seq", "verb", "note"])
    return ends.filter(F.col("verb").isin(*openers))


def decision_moves(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Lines that open or close a decision."""
    moving = F.col("verb").isin(*OPEN_VERBS, vocab.resolved, vocab.held)
    return df.filter(
        F.col("key").isNotNull() & moving & tx.transition_allowed(F.col("key"), F.col("note"), vocab.reserved_prefixes)
    )


def open_decisions(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Decisions still open per log and key; ``seq`` gives the order, most recently opened last.
    ``done`` never closes one. Works on one log or on all of them."""
    guarded = df.filter(
        tx.transition_allowed(F.col("key"), F.col("note"), vocab.reserved_prefixes)
    )
    return _last_transition(guarded, OPEN_VERBS, (vocab.resolved, vocab.held))


def open_activities(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Activities still open. Unlike decisions, terminal verbs close and no key is reserved."""
    closers = (*ACTIVITY_CLOSERS, vocab.resolved, vocab.held)
    return _last_transition(df, ("working", vocab.paused), closers)


def open_blockers(df: DataFrame, tasks: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Open ``blocked`` decisions of live tasks."""
    blocked = open_decisions(df, vocab).filter(F.col("verb") == "blocked")
    return blocked.join(tasks.select("task"), "task", "left_semi").withColumn(
        "note", tx.clean_text(F.col("note"))
    )


def uncovered_decisions(open_set: DataFrame, inventory: DataFrame) -> DataFrame:
    """Open keyed decisions without an inventory entry for ``(task, key)``."""
    return open_set.join(inventory.select("task", "key"), ["task", "key"], "left_anti")


def run_state(df: DataFrame) -> DataFrame:
    """Per log: ``busy`` when a run started and did not end, ``settled`` when all ended, ``none``
    when no run ever started. ``df``: ``task, run_id, seq, event``."""
    started = (F.col("event") == "started").cast("int")
    step_at = F.when(F.col("event").isin("started", "terminal"), F.col("seq"))
    # Flags and positions are fixed-width, so both aggregates stay in hash aggregation.
    runs = df.groupBy("task", "run_id").agg(
        F.max_by(started, step_at).alias("open"), F.max(started).alias("seen"))
    state = (
        F.when(F.max("seen") == 0, "none")
        .when(F.max(F.coalesce("open", F.lit(0))) == 1, "busy")
        .otherwise("settled")
    )
    return runs.groupBy("task").agg(state.alias("run_state"))


def read_busy(records: DataFrame) -> DataFrame:
    """Busy records as text (``task, seq, record``) as rows of :func:`current_busy`, and ``fault``. Of a faulty record no
    field counts, so it makes its task ``malformed``."""
    return records.select("task", "seq", tx.parse_busy(F.col("record")).alias("b")).select("task", "seq", "b.*")


def current_busy(records: DataFrame, armed: DataFrame, trust: DataFrame) -> DataFrame:
    """Verified current state per task. A record counts when it parses, carries the armed
    incarnation and comes from a source trusted for the task's producer; otherwise the state is
    ``unknown`` with a named reason.

    ``records``: ``task, seq, gen, state, source, event, ts`` as strings besides ``seq`` (arrival
    order); ``armed``: ``task, gen, producer`` (gen null when nothing is armed); ``trust``:
    ``producer, source``.
    """
    token = r"^[A-Za-z0-9._-]+$"
    well_formed = (
        F.coalesce(F.col("gen"), F.lit("")).rlike(token)
        & F.coalesce(F.col("source"), F.lit("")).rlike(token)
        & F.coalesce(F.col("event"), F.lit("")).rlike(token)
        & F.coalesce(F.col("record_seq"), F.lit("")).rlike("^[0-9]+$")
        & F.coalesce(F.col("ts"), F.lit("")).rlike("^[0-9]+$")
        & F.coalesce(F.col("state"), F.lit("")).isin("busy", "idle", "unknown")
    )
    current = ordered.latest(
        records, ["task"], "seq", ["gen", "record_seq", "state", "source", "event", "ts"]
    ).withColumn("well_formed", well_formed)
    trusted = trust.select("producer", "source").distinct().withColumn("trusted", F.lit(True))
    joined = (
        armed.select("task", F.col("gen").alias("armed_gen"), "producer")
        .join(current, "task", "left")
        .join(trusted, ["producer", "source"], "left")
    )
    reason = (
        F.when(F.col("well_formed").isNull(), "missing")
        .when(F.col("armed_gen").isNull() | ~F.col("well_formed"), "malformed")
        .when(F.col("gen") != F.col("armed_gen"), "gen-mismatch")
        .when(F.col("trusted").isNull(), "source-mismatch")
    )
    return joined.select(
        "task",
        F.when(reason.isNull(), F.col("state")).otherwise("unknown").alias("state"),
        F.coalesce(reason, F.col("source")).alias("source"),
    )


def dedupe_wakes(df: DataFrame) -> DataFrame:
    """One row per (kind, key), heartbeats all alike: place of the first, content of the last."""
    merge_key = F.when(F.col("kind") == "heartbeat", F.lit("heartbeat")).otherwise(F.col("key"))
    cols = ["epoch", "seq", "kind", "key", "payload"]
    top = F.max_by(F.struct(*cols), F.col("seq")).alias("__top")
    return (
        df.withColumn("__merge", merge_key)
        .groupBy("kind", "__merge")
        .agg(F.min("seq").alias("first_seq"), top)
        .select("first_seq", *[F.col(f"__top.{c}").alias(c) for c in cols])
    )


def queued_keys(df: DataFrame, kind: str) -> DataFrame:
    """Distinct queued keys of one kind; ``first_seq`` orders them, oldest first."""
    if kind not in WAKE_KINDS:
        raise ValueError(f"invalid wake kind: {kind}")
    return df.filter(F.col("kind") == kind).groupBy("key").agg(F.min("seq").alias("first_seq"))


def annotation_modes(wakes: DataFrame) -> DataFrame:
    """Status logs named by signal keys: ``<id>.status`` directly, ``<id>.turn-ended`` as history."""
    ident = F.regexp_extract("key", r"^(.*)\.(status|turn-ended)$", 1)
    valid = (
        ident.rlike("^[A-Za-z0-9_-][A-Za-z0-9._-]*$") & (F.length(ident) <= 64)
    )
    return wakes.filter((F.col("kind") == "signal") & valid).select(
        F.concat(ident, F.lit(".status")).alias("status_key"),
        F.when(F.col("key").endswith(".status"), "direct").otherwise("historical").alias("mode"),
        "seq",
    )


def merge_modes(df: DataFrame) -> DataFrame:
    """One row per status key in order of first sight; ``direct`` beats ``historical``."""
    direct = F.max((F.col("mode") == "direct").cast("int")) == 1
    return df.groupBy("status_key").agg(
        F.when(direct, "direct").otherwise("historical").alias("mode"),
        F.min("seq").alias("first_seq"),
    )


def digest(
    df: DataFrame, keys: Sequence[str], order: str, item: Column, *, part_items: int = 1000
) -> DataFrame:
    """Ordered items joined by `` | `` with their count. A group longer than ``part_items`` yields
    several parts in order, so no task ever holds a whole unbounded group."""
    placed = ordered.rank(df.withColumn("item", item), keys, order, "pos")
    parts = placed.withColumn("part", F.floor((F.col("pos") - 1) / part_items).cast("long"))
    gathered = F.array_sort(F.collect_list(F.struct("pos", "item")))
    return parts.groupBy(*keys, "part").agg(
        F.count("*").alias("items"),
        F.array_join(F.transform(gathered, lambda s: s["item"]), " | ").alias("digest"),
    )


def key_union(*passes: DataFrame) -> DataFrame:
    """Distinct (task, key) over several passes; a row per key, because the union has no bound."""
    out = passes[0].select("task", "key")
    for more in passes[1:]:
        out = out.unionByName(more.select("task", "key"))
    return out.filter(F.col("key") != "").distinct()


def set_signature(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Digest of the distinct members per group, equal exactly when the sets are equal."""
    lanes = [f"__l{i}" for i in range(digests.LANES)]
    members = df.select(*keys, F.col(member).cast("string").alias("__m")).distinct()
    words = digests.element_lanes(F.col("__m"))
    spread = members.select(*keys, *[w.alias(n) for w, n in zip(words, lanes, strict=True)])
    return spread.groupBy(*keys).agg(
        F.count("*").alias("members"),
        digests.digest_of([F.col(n) for n in lanes], F.count("*")).alias("signature"),
    )


def misplaced_hits(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Distinct answering lines seen in the wrong home, per unresolved delivered request.

    ``lines``: ``home, path, line_no, line``; ``requests``: ``corr, home, phase, delivered_epoch``
    where ``home`` is the wrong place to answer."""
    live = requests.filter((F.col("phase") != "resolved") & F.col("delivered_epoch").isNotNull())
    tokens = tx.computed(lines, corr=tx.extract_corr(F.col("line"))).filter("corr IS NOT NULL")
    sightings = tokens.select("corr", "home", "path", "line_no", "line").distinct()
    per_token = sightings.groupBy("corr", "home").agg(F.count("*").alias("hits"))
    return (
        live.select("corr", "home")
        .join(per_token, ["corr", "home"], "left")
        .select("corr", "home", F.coalesce("hits", F.lit(0)).alias("hits"))
    )
