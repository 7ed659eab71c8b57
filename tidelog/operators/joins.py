"""Joins between tasks, backlogs, registries, ledgers, claims and logs.

Right sides that may repeat a key are reduced to one row per key first, so a join never multiplies
rows; the choice between broadcast and shuffle is left to Catalyst, which knows the sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import ordered


def attach_backlog(tasks: DataFrame, backlog: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Every task with its first structured backlog row, columns prefixed ``backlog_``. ``scope``
    names the columns that tell several backlogs apart; an id counts within them."""
    keys = [*scope, "id"]
    cols = [c for c in backlog.columns if c not in (*keys, "seq", "structured")]
    first = ordered.earliest(backlog.filter("structured"), keys, "seq", ["seq", *cols])
    named = first.select(*keys, *[F.col(c).alias(f"backlog_{c}") for c in ["seq", *cols]])
    return tasks.join(named, keys, "left")


def union_registry(registry: DataFrame, tasks: DataFrame, complete: bool) -> DataFrame:
    """Registered homes with their first task, and tasks of homes outside the registry.

    ``registered`` is true, false, or null when an incomplete registry read cannot tell."""
    first = ordered.earliest(tasks, ["id"], "seq", ["seq", "home"]).select(
        "id", F.col("seq").alias("task_seq"), F.col("home").alias("task_home")
    )
    known = registry.withColumn("__in", F.lit(True))
    missing = F.lit(
        "task metadata is not registered" if complete
        else "registration is unknown because the registry read is incomplete or unavailable"
    )
    outside = F.lit(False if complete else None).cast("boolean")
    return known.join(first, "id", "full_outer").select(
        "id",
        F.coalesce("home", "task_home").alias("home"),
        F.when(F.col("__in"), F.lit(True)).otherwise(outside).alias("registered"),
        F.when(F.col("__in"), F.col("registry_error")).otherwise(missing).alias("registry_error"),
        "task_seq",
    )


def orphans(backlog: DataFrame, tasks: DataFrame) -> DataFrame:
    """In-flight rows that need a worker but have none, and live tasks with no in-flight row."""
    owned = backlog.filter((F.col("state") == "in_flight") & F.col("structured"))
    no_task = owned.filter("requires_child").join(tasks.select("id"), "id", "left_anti")
    no_row = tasks.join(owned.select("id"), "id", "left_anti")
    return no_task.select("id", F.lit("orphan_in_flight").alias("kind")).unionByName(
        no_row.select("id", F.lit("unowned_current").alias("kind"))
    )


def owned_with_state(backlog: DataFrame, tasks: DataFrame, states: Sequence[str]) -> DataFrame:
    """In-flight rows whose task is in one of ``states``."""
    owned = backlog.filter((F.col("state") == "in_flight") & F.col("structured"))
    live = tasks.filter(F.col("state").isin(*states))
    return owned.select("id", "seq").join(
        live.select("id", F.col("state").alias("task_state")), "id"
    )


def resolved_ids(backlog: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Ids whose **last** structured record is done: a later record replaces an earlier verdict."""
    done = F.max_by(F.col("state") == "done", F.col("seq"))
    return backlog.filter("structured").groupBy(*scope, "id").agg(done.alias("resolved"))


def open_blockers_by_row(backlog: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """``scope, seq, unresolved`` for the rows that still wait; rows without blockers never enter
    the joins. ``scope`` names the columns that tell several backlogs apart."""
    mentions = backlog.filter(F.col("structured") & (F.size("blocked_by_ids") > 0)).select(
        *scope, "seq", F.posexplode(F.array_distinct("blocked_by_ids")).alias("pos", "blocker"))
    done = resolved_ids(backlog, scope).filter("resolved").select(*scope, F.col("id").alias("blocker"))
    gathered = F.array_sort(F.collect_list(F.struct("pos", "blocker")))
    return (
        mentions.join(done, [*scope, "blocker"], "left_anti")
        .groupBy(*scope, "seq")
        .agg(F.transform(gathered, lambda s: s["blocker"]).alias("unresolved"))
    )


def unresolved_blockers(backlog: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Blockers of each row not yet done, in order of first mention; unknown ids stay open.
    Returns ``scope, seq, id, unresolved`` for every structured row."""
    rows = backlog.filter("structured").select(*scope, "seq", "id", "blocked_by_ids")
    none = F.slice("blocked_by_ids", 1, 0)
    return rows.join(open_blockers_by_row(backlog, scope), [*scope, "seq"], "left").select(
        *scope, "seq", "id", F.coalesce("unresolved", none).alias("unresolved"))


def relevant_reports(reports: DataFrame, live: DataFrame, landed: DataFrame) -> DataFrame:
    """Reports that belong to live or landed ids."""
    wanted = live.select("id").unionByName(landed.select("id"))
    return reports.join(wanted, "id", "left_semi")


def _claim_surfaces(sections: DataFrame) -> DataFrame:
    """One first match per home, verb and key. ``sections``: ``home, surface, seq, id, key, verb,
    blocked_by`` with surface ``active_children``, ``holds`` or ``decisions_open``."""
    s = F.col("surface")
    rows = [
        sections.filter(s == "active_children").select(
            "home", F.lit("working").alias("claim"), F.col("id").alias("match"), "seq", "surface", "id"),
        sections.filter((s == "decisions_open") & (F.col("verb") == "needs-decision")).select(
            "home", F.lit("needs-decision").alias("claim"), F.col("key").alias("match"), "seq", "surface", "id"),
    ]
    both = F.explode(F.array_distinct(F.array("id", "blocked_by")))
    for claim in ("paused", "blocked"):
        rows.append(sections.filter(s == "holds").select(
            "home", F.lit(claim).alias("claim"), both.alias("match"), "seq", "surface", "id"))
    rows.append(
        sections.filter((s == "decisions_open") & (F.col("verb") == "blocked")).select(
            "home", F.lit("blocked").alias("claim"),
            F.explode(F.array_distinct(F.array("key", "id"))).alias("match"), "seq", "surface", "id"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    place = F.struct((F.col("surface") == "holds").alias("late"), F.col("seq"))
    return (
        out.filter(F.col("match").isNotNull())
        .groupBy("home", "claim", "match")
        .agg(F.min_by(F.struct("surface", "id"), place).alias("m"))
        .select("home", "claim", "match", F.col("m.surface").alias("surface"), F.col("m.id").alias("matched"))
    )


def reconcile_claims(claims: DataFrame, sections: DataFrame, complete: DataFrame) -> DataFrame:
    """Compare what a parent log claims with the structured surface of the home.

    ``claims``: ``home, key, verb``; ``complete``: ``home, active_children, holds, decisions_open``
    booleans, true when that surface was read whole. A claim without a specific key proves nothing;
    a missing match contradicts only on a complete surface."""
    keyed = F.col("key").isNotNull() & ~F.col("key").isin("", "default")
    matches = _claim_surfaces(sections)
    joined = (
        claims.join(
            matches.withColumnsRenamed({"claim": "verb", "match": "key"}),
            ["home", "verb", "key"], "left",
        ).join(complete, "home", "left")
    )
    whole = (
        F.when(F.col("verb") == "working", F.col("active_children"))
        .when(F.col("verb") == "paused", F.col("holds"))
        .when(F.col("verb") == "needs-decision", F.col("decisions_open"))
        .when(F.col("verb") == "blocked", F.col("decisions_open") & F.col("holds"))
    )
    compared = (
        F.when(F.col("verb") == "working", "active_children")
        .when(F.col("verb") == "paused", "holds")
        .when(F.col("verb") == "needs-decision", "decisions_open")
        .when(F.col("verb") == "blocked", "decisions_open_or_holds")
    )
    verdict = (
        F.when(compared.isNull() | ~keyed, "inconclusive")
        .when(F.col("matched").isNotNull(), "corroborates")
        .when(F.coalesce(whole, F.lit(False)), "contradicts")
        .otherwise("inconclusive")
    )
    return joined.select(
        "home", "verb", "key", verdict.alias("verdict"), compared.alias("compared_to"),
        F.when(keyed, F.col("matched")).alias("matched"),
    )


def resolve_requests(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """First later line that carries a request's correlation token, and how it answered.

    ``requests``: ``corr, seq``; ``lines``: ``seq, line``. Lines without a token leave before the
    shuffle, and a token's lines join the one request that owns it."""
    hits = tx.computed(lines, corr=tx.extract_corr(F.col("line"))).filter(F.col("corr").isNotNull())
    later = requests.select("corr", F.col("seq").alias("asked")).join(
        hits.select("corr", "seq", "line"), "corr"
    ).filter(F.col("seq") > F.col("asked"))
    answers = later.groupBy("corr").agg(F.min_by(F.struct("seq", "line"), "seq").alias("a"))
    return requests.join(answers, "corr", "left").select(
        *requests.columns,
        F.col("a.seq").alias("answer_seq"),
        F.when(F.col("a").isNotNull(), tx.resolve_via(F.col("a.line"))).alias("via"),
    )


def attribute_runs(tasks: DataFrame, runs: DataFrame, listings: DataFrame) -> DataFrame:
    """Run status bound to each task's branch.

    ``runs``: ``repo, branch, pos`` (0 is newest), ``status, head`` with head relation ``match``,
    ``unresolvable`` or other; ``listings``: ``repo, tainted, incomplete``. The newest row whose
    head matches binds; else ``running`` when exactly one live row exists, its head cannot be
    resolved, the listing is complete and the task allows it. A tainted listing binds nothing.
    ``tasks``: ``task, repo, branch, allow_unresolvable``."""
    live = F.col("status") == "running"
    per_branch = runs.groupBy("repo", "branch").agg(
        F.min_by("status", F.when(F.col("head") == "match", F.col("pos"))).alias("matched"),
        F.sum(live.cast("long")).alias("live_rows"),
        F.max_by("head", F.when(live, F.col("pos"))).alias("live_head"),
    )
    joined = tasks.join(listings, "repo", "left").join(per_branch, ["repo", "branch"], "left")
    sole = (
        F.col("allow_unresolvable")
        & ~F.coalesce("incomplete", F.lit(False))
        & (F.col("live_rows") == 1)
        & (F.col("live_head") == "unresolvable")
    )
    status = F.when(~F.coalesce("tainted", F.lit(False)),
                    F.coalesce("matched", F.when(sole, F.lit("running"))))
    return joined.select("task", status.alias("run_status"))


def unsurfaced(current: DataFrame, surfaced: DataFrame) -> DataFrame:
    """Relevant last lines that differ from the line last surfaced for the task, by content."""
    seen = surfaced.select("task", F.col("line").alias("__seen"))
    return current.join(seen, "task", "left").filter(
        ~F.col("line").eqNullSafe(F.col("__seen"))
    ).drop("__seen")


def pending_results(results: DataFrame, handled: DataFrame) -> DataFrame:
    """Captured results without a handled mark, ordered by sequence and path."""
    return results.join(handled.select("source", "seq"), ["source", "seq"], "left_anti").orderBy(
        "seq", "path"
    )


def coalesce_sources(
    base: DataFrame, sources: Sequence[DataFrame], key: str, valid: Mapping[str, Column]
) -> DataFrame:
    """Each attribute from the first source with a valid value; ``valid`` maps an attribute to the
    check of its value. Sources hold one row per key."""
    out = base
    for i, src in enumerate(sources):
        picked = src.select(
            key, *[F.when(ok, F.col(name)).alias(f"__{i}_{name}") for name, ok in valid.items()]
        )
        out = out.join(picked, key, "left")
    return out.select(
        *base.columns,
        *[F.coalesce(*[F.col(f"__{i}_{n}") for i in range(len(sources))]).alias(n) for n in valid],
    )


def sync_diff(primary: DataFrame, replica: DataFrame, rules: DataFrame) -> DataFrame:
    """What a sync from primary to replica does per ``(target, item)``; the primary wins.

    ``primary``: ``item, digest``; ``replica``: ``target, item, digest``; ``rules``: ``target,
    item, session_scoped, allowed`` lists every inheritable item of every target. Each side may be as long as an
    inventory is, whatever Spark guesses of its size, so the joins sort and none is gathered on the driver."""
    p = primary.select("item", F.col("digest").alias("p")).hint("merge")
    r = replica.select("target", "item", F.col("digest").alias("r")).hint("merge")
    joined = rules.join(p, "item", "left").join(r, ["target", "item"], "left")
    has_p, has_r = F.col("p").isNotNull(), F.col("r").isNotNull()
    action = (
        F.when(F.col("session_scoped"), "scoped-out")
        .when((has_p | has_r) & ~F.col("allowed"), "skipped")
        .when(has_p & ~F.col("p").eqNullSafe(F.col("r")), "pushed")
        .when(~has_p & has_r, "mirrored-absence")
        .otherwise("unchanged")
    )
    return joined.select("target", "item", action.alias("action"))


def classify_retention(
    inventory: DataFrame, live: DataFrame, protected: Column, max_age: int
) -> DataFrame:
    """Why an entry stays, first reason first: protected, live owner, outside the root, too fresh,
    in use; else stale. ``inventory``: ``name, owner, age_secs, inside_root, in_use``."""
    owners = live.select(F.col("id").alias("owner")).distinct().withColumn("__live", F.lit(True))
    verdict = (
        F.when(protected, "protected")
        .when(F.col("__live"), "live-owner")
        .when(~F.col("inside_root"), "outside-root")
        .when(F.col("age_secs") < max_age, "too-fresh")
        .when(F.col("in_use"), "in-use")
        .otherwise("stale")
    )
    return inventory.join(owners, "owner", "left").select(*inventory.columns, verdict.alias("verdict"))
