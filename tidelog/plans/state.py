"""Current state of tasks, decisions reconciled with it, and the absorb classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import folds
from tidelog.vocab import DEFAULT_VOCABULARY, Vocabulary


def run_state_of(status: Column) -> Column:
    """State of a coarse run status."""
    return (
        F.when(status == "running", "working")
        .when(status == "completed", "done")
        .when(status.isin("failed", "cancelled"), "failed")
        .when(status == "gated", "parked")
        .otherwise("unknown")
    )


def current_state(
    tasks: DataFrame, runs: DataFrame, busy: DataFrame, logs: DataFrame,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """One state per task by precedence: attributed run, busy record, last log line, unknown.

    ``tasks``: ``task, kind, reachable``; ``runs``: ``task, run_status`` (from ``attribute_runs``);
    ``busy``: ``task, state, source`` (from ``current_busy``); ``logs``: parsed lines. A decision
    line the run has moved past is flagged ``superseded``; a closing verb is never a state. A
    persistent home ignores the busy record."""
    last = folds.latest_event(logs, ["verb", "note", "line"]).select(
        "task", F.col("verb").alias("log_verb"), F.col("note").alias("log_note"))
    run = runs.select("task", "run_status")
    record = busy.select("task", F.col("state").alias("busy_state"), F.col("source").alias("busy_source"))
    joined = tasks.join(run, "task", "left").join(record, "task", "left").join(last, "task", "left")
    has_run = F.col("run_status").isNotNull()
    run_state = run_state_of(F.col("run_status"))
    log_state = tx.verb_state(F.col("log_verb"), vocab)
    checks_busy = F.col("kind") != "home"
    busy_is = F.coalesce("busy_state", F.lit("unknown"))
    usable_log = F.col("log_verb").isNotNull() & (log_state != "unknown")
    state = (
        F.when(has_run, run_state)
        .when(~F.col("reachable"), "unknown")
        .when(checks_busy & (busy_is == "busy"), "working")
        .when(checks_busy & (busy_is != "idle"), "unknown")
        .when(usable_log, log_state)
        .otherwise("unknown")
    )
    source = (
        F.when(has_run, "run-step")
        .when(~F.col("reachable"), "none")
        .when(checks_busy & (busy_is != "idle"), "pane")
        .when(usable_log, "status-log")
        .otherwise("none")
    )
    detail = (
        F.when(has_run, F.concat(F.lit("run "), F.col("run_status")))
        .when(~F.col("reachable"), "backend target gone")
        .when(checks_busy & (busy_is == "busy"), F.concat(F.lit("busy by "), F.col("busy_source")))
        .when(checks_busy & (busy_is != "idle"),
              F.concat(F.lit("state unavailable: "), F.coalesce("busy_source", F.lit("missing"))))
        .when(usable_log, F.col("log_note"))
        .otherwise("no current-state source available")
    )
    superseded = has_run & F.coalesce(
        F.col("log_verb").isin("needs-decision", "blocked"), F.lit(False)) & (run_state != "parked")
    return joined.select(
        "task", "kind", state.alias("state"), source.alias("source"), detail.alias("detail"),
        superseded.alias("superseded"), "log_verb")


def reconciled_open_decisions(
    logs: DataFrame, states: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Open decisions, cleared for tasks that provably moved past them: a live activity read other
    than parked or blocked, or a final state. Persistent homes are never cleared."""
    read = F.col("source").isin("run-step", "pane")
    moved = (F.col("kind") != "home") & (
        (read & ~F.col("state").isin("parked", "blocked")) | F.col("state").isin("done", "failed"))
    cleared = states.filter(moved).select("task")
    return folds.open_decisions(logs, vocab).join(cleared, "task", "left_anti")


def absorb_class(
    states: DataFrame, logs: DataFrame, liveness: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """``working``, ``paused`` or ``none`` per task: may an idle sign be absorbed?

    A declared pause outranks a running run only together with an open decision or a dead agent, a
    finished task only by its last line, a parked one only together with an open decision.
    ``states``: from :func:`current_state`; ``liveness``: ``task, agent`` with agent ``dead``."""
    open_tasks = folds.open_decisions(logs, vocab).select("task").distinct().withColumn("open", F.lit(True))
    dead = liveness.filter(F.col("agent") == "dead").select("task").distinct().withColumn("dead", F.lit(True))
    joined = states.join(open_tasks, "task", "left").join(dead, "task", "left")
    pause = F.coalesce(F.col("log_verb") == vocab.paused, F.lit(False))
    is_open, is_dead = F.coalesce("open", F.lit(False)), F.coalesce("dead", F.lit(False))
    state, source = F.col("state"), F.col("source")
    working = (state == "working") & source.isin("run-step", "pane")
    absorbed = (
        F.when(state == "paused", "paused")
        .when(working & (source == "run-step") & pause & (is_open | is_dead), "paused")
        .when(working, "working")
        .when((state == "done") & pause, "paused")
        .when((state == "parked") & pause & is_open, "paused")
        .otherwise("none")
    )
    return joined.select("task", absorbed.alias("absorb"))
