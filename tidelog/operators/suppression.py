"""Alert suppression: change detection, hysteresis, edges, staleness, stalls and cadences.

All rules look back through :mod:`tidelog.operators.ordered`, so one entity may hold any share of
the rows; timers go through :mod:`tidelog.operators.anchored`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import anchored, lineage, ordered
from tidelog.vocab import DEFAULT_THRESHOLDS, DEFAULT_VOCABULARY, Thresholds, Vocabulary

_STAMP_PREFIX = r"^\d{4}-\d{2}-\d{2}T[0-9:.,+-]*\s*"


def changed(df: DataFrame, entity: str, order: str, signature: str, **kw) -> DataFrame:
    """Rows whose signature differs from the previous row of the entity, the first row included."""
    seen = ordered.scan(df, [entity], order, previous={"__was": F.col(signature)}, **kw)
    return seen.filter(~F.col(signature).eqNullSafe(F.col("__was"))).drop("__was")


def rising_edges(df: DataFrame, entity: str, order: str, over: Column, **kw) -> DataFrame:
    """Fire when the threshold is crossed upwards; silent while over, armed again below."""
    rows = df.withColumn("__over", over)
    seen = ordered.scan(rows, [entity], order, previous={"__was": F.col("__over")}, **kw)
    return seen.filter(F.col("__over") & ~F.coalesce("__was", F.lit(False))).drop("__over", "__was")


def alert_changes(df: DataFrame, entity: str, order: str, line: str = "line", **kw) -> DataFrame:
    """Fire on a failing line whose text, without its timestamp, differs from the last one fired;
    a healthy line arms again and blank lines do not count. After any failing row the last fired
    text equals that row's text, so one look back is enough."""
    rows = tx.computed(
        df.filter(F.col(line) != ""),
        __bad=tx.line_failed(F.col(line)), __text=F.regexp_replace(line, _STAMP_PREFIX, ""))
    prev = {"__was_bad": F.col("__bad"), "__was_text": F.col("__text")}
    seen = ordered.scan(rows, [entity], order, previous=prev, **kw)
    repeat = F.coalesce(F.col("__was_bad"), F.lit(False)) & (F.col("__was_text") == F.col("__text"))
    return seen.filter(F.col("__bad") & ~repeat).drop("__bad", "__text", "__was_bad", "__was_text")


def fresh_edges(df: DataFrame, entity: str, order: str, to: str = "to_status", **kw) -> DataFrame:
    """``blocked`` fires once until a ``working``; other states neither fire nor clear."""
    moves = df.filter(F.col(to).isin("blocked", "working"))
    seen = ordered.scan(moves, [entity], order, previous={"__was": F.col(to)}, **kw)
    was = F.coalesce(F.col("__was"), F.lit("working"))
    return seen.filter((F.col(to) == "blocked") & (was != "blocked")).drop("__was")


def suppress_paused(
    edges: DataFrame, logs: DataFrame, entity: str, order: str,
    vocab: Vocabulary = DEFAULT_VOCABULARY, **kw,
) -> DataFrame:
    """Mark edges on an entity whose last log line at that position declares a pause. ``edges`` and
    ``logs`` share the integer ``order``; a log line at the same position counts as earlier."""
    both = edges.select(entity, (F.col(order) * 2 + 1).alias("__o"), F.lit(None).cast("string").alias("__verb")).unionByName(
        logs.select(entity, (F.col(order) * 2).alias("__o"), F.col("verb").alias("__verb"))
    )
    seen = ordered.scan(both, [entity], "__o", last={"__last": F.col("__verb")}, **kw)
    return seen.filter(F.col("__verb").isNull()).select(
        entity,
        ((F.col("__o") - 1) / 2).cast("long").alias(order),
        F.coalesce(F.col("__last") == vocab.paused, F.lit(False)).alias("absorbed"),
    )


def stale_polls(df: DataFrame, entity: str = "entity", order: str = "seq", **kw) -> DataFrame:
    """Polls whose content repeated at least twice while not busy. ``stretch`` tells stretches
    apart and rises: the start of the run of equal content, or the last busy poll in it."""
    rows = df.withColumn("__at", F.col(order))
    before = {"__h": F.col("hash"), "__prev": F.col("__at")}
    busy_at = {"__busy": F.when(F.col("busy"), F.col(order))}
    a = ordered.scan(rows, [entity], order, previous=before, last=busy_at, **kw)
    a = a.withColumn("__start", F.when(~F.col("hash").eqNullSafe(F.col("__h")), F.col(order)))
    b = ordered.scan(a, [entity], order, last={"__run": F.col("__start")}, **kw)
    # Stale: neither this poll nor the one before it begins a run of equal content.
    stale = F.col("__start").isNull() & (F.col("__run") != F.col("__prev")) & ~F.col("busy")
    return b.filter(stale).select(*df.columns, F.greatest("__run", "__busy").alias("stretch"))


def wedge_escalations(
    df: DataFrame, entity: str = "entity", order: str = "seq", ts: str = "ts",
    limits: Thresholds = DEFAULT_THRESHOLDS, **kw,
) -> DataFrame:
    """Numbered escalations of stale stretches. The first stale poll starts the timer, a poll at
    least ``stale_escalate`` seconds later escalates and the poll after that starts it again; any
    change or activity ends the stretch. From ``demand_inspect_count`` on the row demands a look."""
    stale = stale_polls(df, entity, order, **kw)
    fired = anchored.chain(stale, entity, "stretch", order, ts, limits.stale_escalate, restart="next")
    return fired.select(
        entity, order, ts, F.col("n").alias("escalation"), F.col("elapsed").alias("idle_secs"),
        (F.col("n") >= limits.demand_inspect_count).alias("demand_inspect"),
    )


def over_busy_bound(
    df: DataFrame, proofs: Sequence[str], now: Column, limit: int = DEFAULT_THRESHOLDS.busy_turn_max
) -> DataFrame:
    """Add ``started`` and ``over_bound``: the newest proof of progress not in the future is older
    than the limit, or there is none."""
    past = [F.when(F.col(p) <= now, F.col(p)) for p in proofs]
    started = F.greatest(*past) if len(past) > 1 else past[0]
    return df.withColumn("started", started).withColumn(
        "over_bound", F.col("started").isNull() | (now - F.col("started") >= limit)
    )


def idle_anchor(
    df: DataFrame, entity: str = "entity", order: str = "seq", ts: str = "ts", **kw
) -> DataFrame:
    """Start of the current non-idle stretch at each poll: the last idle poll, moved back by every
    backward step of the clock since, not below zero; null before the first idle poll. The steps
    are a running total, so the sequential repair is a difference of two totals."""
    a = ordered.scan(df, [entity], order, previous={"__t": F.col(ts)}, **kw)
    step = F.greatest(F.coalesce(F.col("__t") - F.col(ts), F.lit(0)), F.lit(0)).cast("long")
    b = ordered.scan(a.withColumn("__step", step), [entity], order, total={"__sum": F.col("__step")}, **kw)
    b = lineage.cut(b.drop("__t", "__step"))
    mark = F.when(F.col("state") == "idle", F.struct(F.col(ts).alias("t"), F.col("__sum").alias("s")))
    c = ordered.scan(b.withColumn("__mark", mark), [entity], order, last={"__idle": F.col("__mark")}, **kw)
    idle = F.coalesce("__mark", "__idle")
    moved = F.greatest(idle["t"] - (F.col("__sum") - idle["s"]), F.lit(0))
    return c.select(*df.columns, F.when(idle.isNotNull(), moved).alias("anchor"))


def pauses(
    logs: DataFrame, entity: str = "task", order: str = "seq", ts: str = "ts",
    vocab: Vocabulary = DEFAULT_VOCABULARY, **kw,
) -> DataFrame:
    """Declared pauses ``entity, seq, start, end``: a pause lasts until the entity's next line, null
    while it lasts; a repeated pause line anchors a new one."""
    flipped = logs.select(entity, (-F.col(order)).alias("__o"), F.col(order), F.col(ts), "verb")
    nxt = {"end": F.col(ts)}
    seen = ordered.scan(flipped, [entity], "__o", previous=nxt, **kw)
    return seen.filter(F.col("verb") == vocab.paused).select(
        entity, order, F.col(ts).alias("start"), "end"
    )


def pause_resurface(
    paused: DataFrame, now: Column, secs: int = DEFAULT_THRESHOLDS.pause_resurface
) -> DataFrame:
    """One row per elapsed window of every pause: at ``start + k * secs`` while it lasts."""
    until = F.least(F.coalesce(F.col("end"), now), now)
    first = F.col("start") + secs
    ticks = F.when(until >= first, F.sequence(first, until, F.lit(secs).cast("long")))
    return paused.withColumn("at", F.explode(ticks)).withColumn(
        "n", ((F.col("at") - F.col("start")) / secs).cast("long")
    )


def progress_stalls(
    df: DataFrame, entity: str = "entity", order: str = "seq", ts: str = "ts",
    ceiling: int = DEFAULT_THRESHOLDS.progress_ceiling, **kw,
) -> DataFrame:
    """Verdict of every progress check: ``defer`` or ``escalate``.

    Only phases ``working`` and ``done`` may defer, and a dead agent only when done; other rows
    escalate and leave the timer alone. Among the rest the first sight of a token stamps the timer
    and defers, and a token unchanged for ``ceiling`` seconds escalates and stamps it again."""
    dead = (F.col("agent") == "dead") & (F.col("phase") != "done")
    eligible = F.col("phase").isin("working", "done") & ~dead & F.col("token").isNotNull()
    rows = df.withColumn("__ok", eligible)
    ok = rows.filter("__ok")
    a = ordered.scan(ok, [entity], order, previous={"__tok": F.col("token")}, **kw)
    moved = F.when(~F.col("token").eqNullSafe(F.col("__tok")), F.col(order))
    b = ordered.scan(a.withColumn("__moved", moved), [entity], order, last={"__since": F.col("__moved")}, **kw)
    stretch = b.withColumn("stretch", F.coalesce("__moved", "__since"))
    fired = anchored.chain(stretch, entity, "stretch", order, ts, ceiling, restart="same")
    hits = fired.select(entity, F.col(order), F.lit(True).alias("__fired"))
    verdict = F.when(F.col("__ok") & F.col("__fired").isNull(), "defer").otherwise("escalate")
    return rows.join(hits, [entity, order], "left").select(
        *df.columns, verdict.alias("verdict"), F.col("__fired").isNotNull().alias("stalled")
    )


def batches(df: DataFrame, entity: str, order: str, ts: str, window: int, **kw) -> DataFrame:
    """Windows of fixed length that open at the first row after the previous window: ``entity,
    opened_at, opened_seq``. An anchored window, not a gap session: rows inside do not extend it."""
    firsts = ordered.earliest(df, [entity], order, [order, ts]).withColumnRenamed(ts, "opened_at")
    one = df.withColumn("__ep", F.lit(0).cast("long"))
    more = anchored.chain(one, entity, "__ep", order, ts, window, restart="same")
    return firsts.select(entity, "opened_at", F.col(order).alias("opened_seq")).unionByName(
        more.select(entity, F.col(ts).alias("opened_at"), F.col(order).alias("opened_seq"))
    )


def followup_due(
    links: DataFrame, posts: DataFrame, now: Column,
    cap: int = DEFAULT_THRESHOLDS.followup_cap, age: int = DEFAULT_THRESHOLDS.followup_age,
) -> DataFrame:
    """Requests that may still get a follow-up: fewer than ``cap`` posts and not older than
    ``age``; a missing timestamp cannot prove that and counts as expired."""
    counts = posts.groupBy("request").agg(F.count("*").alias("posts"))
    n = F.coalesce("posts", F.lit(0))
    reason = F.when(n >= cap, "follow-up cap reached").when(
        F.col("ts").isNull() | (now - F.col("ts") > age), "follow-up window elapsed"
    )
    return links.join(counts, "request", "left").select(
        *links.columns, n.alias("posts"), reason.isNull().alias("due"), reason.alias("reason")
    )


def prune_ttl(
    df: DataFrame, now: Column, ttl: int = DEFAULT_THRESHOLDS.followup_age,
    recorded: str = "recorded_at", fallback: str = "mtime",
) -> DataFrame:
    """Keep records not older than ``ttl`` (seven days at most). The recorded time counts unless it
    is missing or in the future, then the file time; without a usable time the record goes."""
    limit = min(ttl, DEFAULT_THRESHOLDS.followup_age)
    at = F.coalesce(*[F.when(F.col(c) <= now, F.col(c)) for c in (recorded, fallback)])
    return df.withColumn("recorded", at).filter(now - F.col("recorded") <= limit)
