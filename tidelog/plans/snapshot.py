"""The snapshot over all homes and the bounded digest drawn from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import joins, lineage, ranking, rollups
from tidelog.plans import state as st
from tidelog.sources.backlog import with_roles
from tidelog.vocab import DEFAULT_VOCABULARY, Vocabulary

MAIN = "(main)"


def fleet_snapshot(
    backlog: DataFrame, tasks: DataFrame, runs: DataFrame, busy: DataFrame, logs: DataFrame,
    registry: DataFrame, reports: DataFrame, *, registry_complete: bool = True,
    materialise: bool = False, scope: Sequence[str] = (), vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> dict[str, DataFrame]:
    """Sections of the snapshot as lazy DataFrames; only the sections used are computed.

    ``backlog``: rows of :func:`tidelog.sources.backlog.parse_backlog` plus ``home``, before roles;
    ``tasks``: ``home, task, seq, kind, reachable``; the rest as in the operators named.
    ``scope``: ``["home"]`` where each home has a backlog of its own, with line numbers and ids that
    others use too; without it ``seq`` and ids must be unique over all homes.
    ``materialise`` computes the rows and the states once for all sections that read them."""
    rows = with_roles(backlog, scope)
    states = st.current_state(tasks.select("task", "kind", "reachable"), runs, busy, logs, vocab)
    if materialise:
        rows, states = lineage.cut(rows), lineage.cut(states)
    live = tasks.select("home", "task", "seq").join(states, "task").withColumn("id", F.col("task"))
    decisions = st.reconciled_open_decisions(logs, states, vocab).join(
        tasks.select("home", "task"), "task").withColumn("id", F.col("task"))
    blocked = rows.withColumn("blocked", F.coalesce(F.size("unresolved") > 0, F.lit(False)))
    known = registry.select("id", "home", "registry_error")
    homes = tasks.filter(F.col("kind") == "home").select(F.col("task").alias("id"), "seq", "home")
    reported = reports.join(
        live.groupBy("id").agg(F.min("kind").alias("task_kind")), "id", "left"
    ).join(
        rows.filter("structured").groupBy("id").agg(
            F.min_by("kind", F.struct(*scope, "seq")).alias("row_kind")), "id", "left"
    ).withColumn("kind", F.coalesce("task_kind", "row_kind", F.lit("scout"))).drop("task_kind", "row_kind")
    return {
        "backlog": rows,
        "tasks": joins.attach_backlog(live, rows.select(
            "home", "id", "seq", "structured", "title", "role", "kind", "state", "hold_reason"), scope),
        "decisions": decisions,
        "inventory": rollups.inventory_validity(rows, live),
        "homes": rollups.home_summary(blocked, live, decisions),
        "registry": joins.union_registry(known, homes, registry_complete),
        "reports": reported,
    }


@dataclass(frozen=True)
class Bounds:
    """Rows shown per section; ``None`` shows all of them."""

    in_flight: int | None = 20
    homes: int | None = 20
    decisions: int | None = 20
    landed: int | None = 6
    landed_per_home: int | None = 6
    gates: int | None = 20
    reports: int | None = 20


def landed_rows(backlog: DataFrame) -> DataFrame:
    captain = F.coalesce(F.col("kind") == "captain", F.lit(False))
    return backlog.filter((F.col("state") == "done") & F.col("structured") & ~captain)


def open_gates(
    backlog: DataFrame, working: DataFrame, include_superseded: bool = False
) -> DataFrame:
    """Queued rows that wait for something, and held in-flight rows that are not being worked on.
    ``backlog``: rows with roles; ``working``: ``id`` of tasks at work."""
    at_work = working.select("id").distinct().withColumn("__working", F.lit(True))
    held = (F.col("state") == "in_flight") & (F.col("role") == "held") & F.col("__working").isNull()
    rows = backlog.filter("structured").join(at_work, "id", "left").filter(
        ((F.col("state") == "queued") | held) & ~F.col("actionable"))
    if not include_superseded:
        rows = rows.filter(~tx.is_superseded(F.col("body_excerpt")))
    blockers = F.array_join("unresolved", ",")
    return rows.select(
        "home", "seq", "id",
        tx.ellipsize(F.col("title"), 60).alias("title"),
        F.when(blockers != "", tx.ellipsize(blockers, 120)).otherwise("-").alias("blocked_by"),
        tx.ellipsize(F.coalesce("hold_reason", "blocked_reason", F.lit("-")), 40).alias("reason"),
    )


def actionable_decisions(backlog: DataFrame) -> DataFrame:
    """Rows that only wait for the captain's decision."""
    return backlog.filter(F.col("structured") & F.col("actionable")).select(
        "home", "seq", "id", F.col("id").alias("key"), F.lit("captain-hold").alias("verb"),
        tx.ellipsize(F.concat_ws(": ", "title", "hold_reason"), 90).alias("summary"))


def in_flight_rows(tasks: DataFrame) -> DataFrame:
    """Tasks at work, without aggregate programs and idle held rows."""
    role = F.coalesce("backlog_role", F.lit(""))
    return tasks.filter(
        (F.col("kind") != "home") & (role != "program")
        & ((role != "held") | (F.col("state") == "working"))
    ).select("home", "seq", "id", "kind", "state", tx.ellipsize(F.col("detail"), 90).alias("doing"))


def bearings(
    snapshot: Mapping[str, DataFrame], bounds: Bounds = Bounds(), include_superseded: bool = False
) -> dict[str, DataFrame]:
    """The bounded digest: seven sections and ``omitted``, one row per thing left out.

    Every cap is a top-k plan or a per-home group limit, and what a cap hides is counted. Several
    sections read the backlog and the tasks: build the snapshot with ``materialise``."""
    rows, tasks = snapshot["backlog"], snapshot["tasks"]
    landed = landed_rows(rows).select(
        "home", "id", "title", F.col("completion.date").alias("date"),
        F.coalesce("pr_url", "report_path", "local_note", F.lit("-")).alias("artifact"))
    working = tasks.filter((F.col("kind") != "home") & (F.col("state") == "working")).select("id")
    if bounds.landed is None:
        done = ranking.landed_all(landed)
    else:
        done = ranking.round_robin(landed, bounds.landed, bounds.landed_per_home)
    live = tasks.filter(F.col("kind") != "home").select("id")
    named = {
        "in_flight": (in_flight_rows(tasks), ["seq"], bounds.in_flight),
        "homes": (snapshot["homes"], ["home"], bounds.homes),
        "decisions_open": (actionable_decisions(rows), ["seq"], bounds.decisions),
        "gates": (open_gates(rows, working, include_superseded), ["seq"], bounds.gates),
        "reports": (joins.relevant_reports(snapshot["reports"], live, done), ["id"], bounds.reports),
    }
    out: dict[str, DataFrame] = {
        "landed": done.select("home", "id", tx.ellipsize(F.col("title"), 70).alias("what"), "artifact")
    }
    omitted = None
    for name, (df, order, limit) in named.items():
        out[name], note = ranking.cap_section(df, name, order, limit, f"--all-{name}")
        omitted = note if omitted is None else omitted.unionByName(note)
    out["registry"] = snapshot["registry"]
    if bounds.landed is not None:
        omitted = omitted.unionByName(_landed_omitted(landed, bounds))
    orphans = snapshot["inventory"].agg(F.sum("orphans").alias("n")).filter("n > 0").select(
        F.lit("inventory").alias("section"),
        F.concat(F.lit("in-flight backlog item(s) have no child metadata: "), F.col("n").cast("string")).alias("surface"),
        F.lit("inspect the backlog").alias("reveal"))
    out["omitted"] = omitted.unionByName(orphans)
    return out


def _landed_omitted(landed: DataFrame, bounds: Bounds) -> DataFrame:
    cap = bounds.landed_per_home or bounds.landed
    per_home = landed.groupBy("home").agg(F.count("*").alias("n"))
    totals = per_home.agg(
        F.coalesce(F.sum(F.least("n", F.lit(cap))), F.lit(0)).alias("offered"),
        F.coalesce(F.sum((F.col("n") > cap).cast("long")), F.lit(0)).alias("cut"))
    shown = F.least(F.col("offered"), F.lit(bounds.landed))

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    notes = F.array_compact(F.array(
        F.when(F.col("offered") > shown, text("landed showing ", shown, " of ", F.col("offered"))),
        F.when(F.col("cut") > 0, text(f"landed per-home capped at {cap} for ", F.col("cut"), " home(s)")),
    ))
    return totals.select(
        F.lit("landed").alias("section"), F.explode(notes).alias("surface"),
        F.lit("--all-landed").alias("reveal"))


def pending_commitments(registry: DataFrame, obligations: DataFrame, events: DataFrame, consumed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unresolved commitments, after dropping registrations whose obligation is gone or closed, and
    the count of terminal events nobody consumed.

    ``registry``: ``id``; ``obligations``: ``id, state, delivery, platform, request, summary``;
    ``events`` and ``consumed``: ``event_id``."""
    closed = (F.col("state") == "done") | F.coalesce(F.col("delivery").isin("posted", "waived"), F.lit(False))
    unknown = F.lit("unknown")
    pending = registry.select("id").distinct().join(obligations.filter(~closed), "id").select(
        "id", F.coalesce("delivery", unknown).alias("delivery"),
        F.coalesce("platform", unknown).alias("platform"),
        F.coalesce("request", unknown).alias("request"),
        tx.clean_text(F.col("summary"), "squeeze").alias("summary"))
    waiting = events.select("event_id").distinct().join(
        consumed.select("event_id"), "event_id", "left_anti").agg(F.count("*").alias("unconsumed"))
    return pending, waiting


def open_decision_report(decisions: DataFrame, *, item_chars: int = 219, total: int = 4000) -> DataFrame:
    """Lines of the open-decision section within a byte budget: each line is cut to ``item_chars``,
    a line that no longer fits is skipped and the next one tried."""
    token = F.when(F.col("key") == "default", F.lit("")).otherwise(
        F.concat(F.lit(" [key="), F.col("key"), F.lit("]")))
    line = F.concat(F.col("task").cast("string"), token, F.lit(" "), F.col("verb"), F.lit(": "), F.col("note"))
    lines = decisions.select("seq", tx.cap_line(line, item_chars).alias("line")).withColumn(
        "size", (F.length("line") + 1).cast("long"))
    return ranking.fit_budget(lines, [], "seq", "size", total)
