"""Plain aggregates: timing rollups, inventory validity, home summaries and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as tx


def family_rollup(df: DataFrame) -> DataFrame:
    """Scripts, total duration and failures per family. ``df``: ``family, duration_ms, exit``."""
    return df.groupBy("family").agg(
        F.count("*").alias("scripts"),
        F.sum(F.col("duration_ms").cast("long")).alias("duration_ms"),
        F.sum((F.col("exit") != 0).cast("long")).alias("failed"),
    )


def lane_totals(df: DataFrame) -> DataFrame:
    """One row over all lanes: sums, and the longest lane as the critical path.
    ``df``: one row per lane with ``total, failed, skipped_gate, duration_ms``."""
    return df.agg(
        F.count("*").alias("lanes"),
        F.sum("total").alias("total"),
        F.sum("failed").alias("failed"),
        F.sum("skipped_gate").alias("skipped_gate"),
        F.max("duration_ms").alias("critical_path_ms"),
    )


def slowest(df: DataFrame, limit: int = 15) -> DataFrame:
    """Longest scripts, ties by path. A top-k plan: every task keeps ``limit`` rows."""
    return df.orderBy(F.col("duration_ms").desc(), F.col("path")).limit(limit)


def budget_report(df: DataFrame, budget: int, shared: str) -> DataFrame:
    """Token estimate per owner against a budget, flagging one shared file that alone exceeds it.
    ``df``: ``owner, file, text``."""
    sized = df.withColumn("tokens", tx.est_tokens(F.col("text")))
    shared_tokens = F.max(F.when(F.col("file") == shared, F.col("tokens")))
    return sized.groupBy("owner").agg(
        F.sum("tokens").alias("total_tokens"),
        F.when(F.sum("tokens") <= budget, "within-budget").otherwise("over-budget").alias("status"),
        F.coalesce(shared_tokens > budget, F.lit(False)).alias("shared_exceeds"),
    )


def _first_reason(*pairs: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for condition, reason in reversed(pairs):
        out = F.when(condition, reason).otherwise(out)
    return out


def inventory_validity(backlog: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per home: free-form current rows, in-flight rows whose worker is missing, first reason.

    ``backlog``: ``home, id, state, structured, requires_child``; ``tasks``: ``home, id``."""
    owned = backlog.filter(
        (F.col("state") == "in_flight") & F.col("structured") & F.col("requires_child")
    )
    orphans = (
        owned.join(tasks.select("home", "id"), ["home", "id"], "left_anti")
        .groupBy("home")
        .agg(F.count("*").alias("orphans"))
    )
    current = F.col("state").isin("in_flight", "queued") & ~F.col("structured")
    free = backlog.groupBy("home").agg(F.sum(current.cast("long")).alias("unstructured"))
    n = F.coalesce("orphans", F.lit(0)).cast("long")
    return free.join(orphans, "home", "left").select(
        "home",
        "unstructured",
        n.alias("orphans"),
        ((F.col("unstructured") == 0) & (n == 0)).alias("valid"),
        _first_reason(
            (F.col("unstructured") > 0, "unstructured current backlog row"),
            (n > 0, "in-flight backlog item has no child metadata"),
        ).alias("reason"),
    )


def home_invalidities(backlog: DataFrame, tasks: DataFrame) -> DataFrame:
    """The rows behind an invalid home, one per offending id: ``home, kind, id``."""
    owned = backlog.filter((F.col("state") == "in_flight") & F.col("structured"))
    orphan = owned.filter("requires_child").join(
        tasks.select("home", "id"), ["home", "id"], "left_anti"
    )
    unowned = tasks.join(owned.select("home", "id"), ["home", "id"], "left_anti")
    terminal = owned.select("home", "id").join(
        tasks.filter(F.col("state").isin("done", "failed")).select("home", "id"), ["home", "id"]
    )
    unknown = tasks.filter(F.col("state") == "unknown")
    named = [
        (orphan, "orphan_in_flight"),
        (unowned, "unowned_current"),
        (terminal, "terminal_in_flight"),
        (unknown, "child_current_unavailable"),
    ]
    out = None
    for rows, kind in named:
        part = rows.select("home", F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def home_summary(backlog: DataFrame, tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """State of every home with counts, validity and the first failing reason.

    ``backlog``: ``home, id, seq, state, structured, kind, role, requires_child, hold_kind,
    hold_reason, actionable, blocked`` (``blocked``: has unresolved blockers); ``tasks``: ``home,
    id, kind, state``; ``decisions``: open keyed decisions ``home, id, verb``. Ids behind a reason
    are rows of :func:`home_invalidities`, because their list has no bound.
    """
    b = backlog.alias("b")
    t = tasks.select(F.col("home").alias("t_home"), F.col("id").alias("t_id"),
                     F.col("state").alias("t_state"))
    held = F.col("hold_reason").isNotNull() & F.col("hold_kind").isNotNull()
    joined = b.join(
        t, (F.col("b.home") == F.col("t_home")) & (F.col("b.id") == F.col("t_id")), "left"
    )
    in_flight = (F.col("b.state") == "in_flight") & F.col("structured")
    queued = F.col("structured") & (
        (F.col("b.state") == "queued")
        | (in_flight & (F.col("role") == "held") & ~F.coalesce(F.col("t_state") == "working", F.lit(False)))
    )
    waiting = F.col("t_state").isin("parked", "paused", "blocked")

    def n(cond: Column) -> Column:
        return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))

    per_backlog = joined.groupBy("home").agg(
        n(F.col("b.state").isin("in_flight", "queued") & ~F.col("structured")).alias("unstructured"),
        n(in_flight & F.col("requires_child") & F.col("t_id").isNull()).alias("orphan_in_flight"),
        n(in_flight & F.col("t_state").isin("done", "failed")).alias("terminal_in_flight"),
        n(in_flight & (F.col("role") != "program") & (F.col("t_state") == "working")).alias("active_children"),
        n(queued).alias("queued"),
        n(queued & F.col("actionable")).alias("captain_holds"),
        n(queued & (F.col("blocked") | held)).alias("queue_holds"),
        n(in_flight & waiting & ~held).alias("child_holds"),
        n((F.col("b.state") == "done") & F.col("structured")
          & ~F.coalesce(F.col("b.kind") == "captain", F.lit(False))).alias("landed"),
    )
    owned = backlog.filter((F.col("state") == "in_flight") & F.col("structured"))
    flags = owned.select("home", "id", F.lit(True).alias("owned")).distinct()
    per_task = (
        tasks.join(flags, ["home", "id"], "left")
        .groupBy("home")
        .agg(
            F.count("*").alias("endpoints"),
            n(F.col("owned").isNull()).alias("unowned_current"),
            n(F.col("state") == "unknown").alias("unknown_children"),
        )
    )
    per_open = decisions.groupBy("home").agg(
        F.count("*").alias("status_decisions"),
        n(F.col("verb") == "needs-decision").alias("needs_decision"),
    )
    counts = ["unstructured", "orphan_in_flight", "terminal_in_flight", "active_children", "queued",
              "captain_holds", "queue_holds", "child_holds", "landed", "endpoints",
              "unowned_current", "unknown_children", "status_decisions", "needs_decision"]
    wide = (
        per_backlog.withColumn("present", F.lit(True))
        .join(per_task, "home", "full_outer")
        .join(per_open, "home", "full_outer")
        .select("home", F.coalesce("present", F.lit(False)).alias("present"),
                *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    )
    reason = _first_reason(
        (~F.col("present"), "missing structured backlog"),
        (F.col("unstructured") > 0, "unstructured current backlog row"),
        (F.col("orphan_in_flight") > 0, "in-flight backlog item has no child metadata"),
        (F.col("unowned_current") > 0, "live child state has no in-flight backlog item"),
        (F.col("terminal_in_flight") > 0, "in-flight backlog item has terminal child state"),
        (F.col("unknown_children") > 0, "child current state unavailable"),
    )
    holds = F.col("queue_holds") + F.col("child_holds")
    state = (
        F.when(reason.isNotNull(), "unknown")
        .when(F.col("needs_decision") + F.col("captain_holds") > 0, "captain_decision")
        .when(F.col("active_children") > 0, "active_child_work")
        .when(holds > 0, "externally_held")
        .otherwise("no_active_work")
    )
    return wide.select(
        "home",
        reason.isNull().alias("valid"),
        reason.alias("reason"),
        state.alias("state"),
        "active_children",
        (F.col("captain_holds") + F.col("status_decisions")).alias("decisions_open"),
        holds.alias("holds"),
        "queued",
        "landed",
        "endpoints",
    )
