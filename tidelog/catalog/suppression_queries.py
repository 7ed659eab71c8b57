"""Alert suppression rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import query
from tidelog.catalog.text_queries import deploy_line
from tidelog.catalog.views import table, view, with_views
from tidelog.operators import suppression as sup

NOW = 1706745600  # fixed evaluation time after the last event of the given tables


@query("signature_changes", with_views("""
SELECT task, seq, verb FROM (SELECT task, seq, verb, lag(verb) OVER (PARTITION BY task ORDER BY seq) AS was FROM status_events)
WHERE verb IS DISTINCT FROM was"""))
def signature_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "status_events").select("task", "seq", "verb")
    return sup.changed(rows, "task", "seq", "verb")


@query("rising_edges", with_views("""
SELECT task, seq, value FROM (SELECT task, seq, value, value >= 40 AS over_it,
  lag(value >= 40) OVER (PARTITION BY task ORDER BY seq) AS was FROM status_events) WHERE over_it AND NOT coalesce(was, false)"""))
def rising_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "status_events").select("task", "seq", "value")
    return sup.rising_edges(rows, "task", "seq", F.col("value") >= 40)


@query("alert_changes", with_views("""
WITH d AS (SELECT task, seq, CASE WHEN event_type = 'error' THEN concat('2024-01-01T00:00:00Z FAILED: code ', CAST(k % 4 AS STRING))
    WHEN k % 7 = 0 THEN concat('ALERT raised ', note) WHEN k % 7 = 1 THEN 'ALERTS are off' WHEN k % 7 = 2 THEN '' ELSE concat('ok ', note) END AS line FROM status_events),
x AS (SELECT task, seq, line, regexp_matches(line, 'STUCK:|FAILED:|needs attention|(^|[ ])ALERT([ ]|$)') AS bad,
    regexp_replace(line, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.,+-]*[ ]*', '') AS txt FROM d WHERE line <> ''),
p AS (SELECT *, lag(bad) OVER w AS was_bad, lag(txt) OVER w AS was_txt FROM x WINDOW w AS (PARTITION BY task ORDER BY seq))
SELECT task, seq, line FROM p WHERE bad AND NOT (coalesce(was_bad, false) AND was_txt = txt)"""))
def alert_changes(spark: SparkSession, sf: str) -> DataFrame:
    blank = (F.col("event_type") != "error") & (F.col("k") % 7 == 2)
    rows = view(spark, sf, "status_events").select(
        "task", "seq", F.when(blank, "").otherwise(deploy_line()).alias("line"))
    return sup.alert_changes(rows, "task", "seq")


@query("fresh_edges", with_views("""
SELECT entity, seq FROM (SELECT entity, seq, to_status, lag(to_status) OVER (PARTITION BY entity ORDER BY seq) AS was
  FROM transitions WHERE to_status IN ('blocked', 'working')) WHERE to_status = 'blocked' AND coalesce(was, 'working') = 'working'"""))
def fresh_edges(spark: SparkSession, sf: str) -> DataFrame:
    return sup.fresh_edges(view(spark, sf, "transitions"), "entity", "seq").select("entity", "seq")


@query("suppress_paused", with_views("""
WITH e AS (SELECT entity, seq FROM (SELECT entity, seq, to_status, lag(to_status) OVER (PARTITION BY entity ORDER BY seq) AS was
  FROM transitions WHERE to_status IN ('blocked', 'working')) WHERE to_status = 'blocked' AND coalesce(was, 'working') = 'working'),
l AS (SELECT task, seq, verb FROM status_events WHERE event_type <> 'error')
SELECT e.entity, e.seq, coalesce(l.verb = 'paused', false) AS absorbed FROM e ASOF LEFT JOIN l ON l.task = e.entity AND l.seq <= e.seq"""))
def suppress_paused(spark: SparkSession, sf: str) -> DataFrame:
    edges = sup.fresh_edges(view(spark, sf, "transitions"), "entity", "seq").select("entity", "seq")
    logs = view(spark, sf, "status_events").filter("event_type <> 'error'").select(
        F.col("task").alias("entity"), "seq", "verb")
    return sup.suppress_paused(edges, logs, "entity", "seq")


_STALE = """
h AS (SELECT *, lag(hash) OVER w AS p1, lag(hash, 2) OVER w AS p2 FROM polls WINDOW w AS (PARTITION BY entity ORDER BY seq)),
s AS (SELECT entity, seq, ts, coalesce(hash = p1, false) AND coalesce(p1 = p2, false) AND NOT busy AS stale FROM h),
g AS (SELECT *, coalesce(max(CASE WHEN NOT stale THEN seq END) OVER (PARTITION BY entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS stretch FROM s)"""


@query("stale_polls", with_views(f"WITH {_STALE} SELECT entity, seq, ts, first_value(seq) OVER (PARTITION BY entity, stretch ORDER BY seq) AS first_seq FROM g WHERE stale"))
def stale_polls(spark: SparkSession, sf: str) -> DataFrame:
    polls = view(spark, sf, "polls").select("entity", "seq", "ts", "hash", "busy")
    stale = sup.stale_polls(polls)
    first = stale.groupBy("entity", "stretch").agg(F.min("seq").alias("first_seq"))
    return stale.join(first, ["entity", "stretch"]).select("entity", "seq", "ts", "first_seq")


@query("wedge_escalations", with_views(f"""
WITH RECURSIVE {_STALE},
i AS (SELECT entity, stretch, seq, ts, row_number() OVER (PARTITION BY entity, stretch ORDER BY seq) AS i FROM g WHERE stale),
walk AS (SELECT entity, stretch, i, seq, ts, ts AS since, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS idle, false AS fired FROM i WHERE i = 1
  UNION ALL SELECT w.entity, w.stretch, x.i, x.seq, x.ts,
    CASE WHEN w.since IS NULL THEN x.ts WHEN x.ts - w.since >= 240 THEN NULL ELSE w.since END,
    CASE WHEN w.since IS NOT NULL AND x.ts - w.since >= 240 THEN w.n + 1 ELSE w.n END, coalesce(x.ts - w.since, 0),
    w.since IS NOT NULL AND x.ts - w.since >= 240
  FROM walk w JOIN i x ON x.entity = w.entity AND x.stretch = w.stretch AND x.i = w.i + 1)
SELECT entity, seq, ts, n AS escalation, idle AS idle_secs, n >= 3 AS demand_inspect FROM walk WHERE fired"""))
def wedge_escalations(spark: SparkSession, sf: str) -> DataFrame:
    return sup.wedge_escalations(view(spark, sf, "polls").select("entity", "seq", "ts", "hash", "busy"))


@query("over_busy_bound", """
WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1000000 + o_orderkey % 50000 END AS a,
  CASE WHEN o_orderkey % 4 = 0 THEN 1000000 + o_custkey * 10 END AS b, CASE WHEN o_orderkey % 7 <> 0 THEN 990000 + o_custkey END AS c FROM orders),
g AS (SELECT id, greatest(CASE WHEN a <= 1020000 THEN a END, CASE WHEN b <= 1020000 THEN b END, CASE WHEN c <= 1020000 THEN c END) AS started FROM p)
SELECT id, started, started IS NULL OR 1020000 - started >= 14400 AS over_bound FROM g""")
def over_busy_bound(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        key.alias("id"), F.when(key % 3 == 0, 1000000 + key % 50000).alias("a"),
        F.when(key % 4 == 0, 1000000 + cust * 10).alias("b"), F.when(key % 7 != 0, 990000 + cust).alias("c"))
    return sup.over_busy_bound(rows, ["a", "b", "c"], F.lit(1020000)).select("id", "started", "over_bound")




@query("idle_anchor", with_views(f"""
WITH RECURSIVE p AS (SELECT entity, seq, ts - CASE WHEN seq % 10 = 9 THEN 7200 ELSE 0 END AS t, state,
    row_number() OVER (PARTITION BY entity ORDER BY seq) AS i FROM polls),
walk AS (SELECT entity, i, seq, t, CASE WHEN state = 'idle' THEN t END AS anchor FROM p WHERE i = 1
  UNION ALL SELECT w.entity, x.i, x.seq, x.t, CASE WHEN x.state = 'idle' THEN x.t
    WHEN w.anchor IS NULL THEN NULL WHEN x.t < w.t THEN greatest(w.anchor - (w.t - x.t), 0) ELSE w.anchor END
  FROM walk w JOIN p x ON x.entity = w.entity AND x.i = w.i + 1)
SELECT entity, seq, anchor FROM walk"""))
def idle_anchor(spark: SparkSession, sf: str) -> DataFrame:
    back = F.when(F.col("seq") % 10 == 9, 7200).otherwise(0)
    polls = view(spark, sf, "polls").select("entity", "seq", (F.col("ts") - back).alias("ts"), "state")
    return sup.idle_anchor(polls).select("entity", "seq", "anchor")


@query("pause_resurface", with_views(f"""
WITH p AS (SELECT task, seq, ts AS start, lead(ts) OVER (PARTITION BY task ORDER BY seq) AS stop, verb FROM status_events),
x AS (SELECT task, seq, start, unnest(range(1, CAST(floor((least(coalesce(stop, {NOW}), {NOW}) - start) / 3600.0) AS BIGINT) + 1)) AS n FROM p WHERE verb = 'paused')
SELECT task, seq, n, start + n * 3600 AS at FROM x"""))
def pause_resurface(spark: SparkSession, sf: str) -> DataFrame:
    logs = view(spark, sf, "status_events").select("task", "seq", "ts", "verb")
    return sup.pause_resurface(sup.pauses(logs), F.lit(NOW).cast("long")).select("task", "seq", "n", "at")


@query("progress_stalls", with_views("""
WITH RECURSIVE p AS (SELECT *, phase IN ('working', 'done') AND NOT (agent = 'dead' AND phase <> 'done') AS ok FROM checks),
i AS (SELECT entity, seq, ts, token, row_number() OVER (PARTITION BY entity ORDER BY seq) AS i FROM p WHERE ok),
walk AS (SELECT entity, i, seq, token, ts AS stamp, false AS stalled FROM i WHERE i = 1
  UNION ALL SELECT w.entity, x.i, x.seq, x.token, CASE WHEN x.token <> w.token OR x.ts - w.stamp >= 5400 THEN x.ts ELSE w.stamp END,
    x.token = w.token AND x.ts - w.stamp >= 5400
  FROM walk w JOIN i x ON x.entity = w.entity AND x.i = w.i + 1)
SELECT p.entity, p.seq, CASE WHEN p.ok AND NOT w.stalled THEN 'defer' ELSE 'escalate' END AS verdict, coalesce(w.stalled, false) AS stalled
FROM p LEFT JOIN walk w ON w.entity = p.entity AND w.seq = p.seq"""))
def progress_stalls(spark: SparkSession, sf: str) -> DataFrame:
    return sup.progress_stalls(view(spark, sf, "checks")).select("entity", "seq", "verdict", "stalled")


@query("anchored_batches", with_views("""
WITH RECURSIVE i AS (SELECT task % 20 AS entity, seq, ts, row_number() OVER (PARTITION BY task % 20 ORDER BY seq) AS i FROM status_events),
walk AS (SELECT entity, i, seq, ts AS opened, true AS opens FROM i WHERE i = 1
  UNION ALL SELECT w.entity, x.i, x.seq, CASE WHEN x.ts - w.opened >= 9000 THEN x.ts ELSE w.opened END, x.ts - w.opened >= 9000
  FROM walk w JOIN i x ON x.entity = w.entity AND x.i = w.i + 1)
SELECT entity, opened AS opened_at, seq AS opened_seq FROM walk WHERE opens"""))
def anchored_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "status_events").select((F.col("task") % 20).alias("entity"), "seq", "ts")
    return sup.batches(rows, "entity", "seq", "ts", 9000)


@query("followup_due", with_views("""
WITH l AS (SELECT seq AS request, task, CASE WHEN k % 12 = 0 THEN NULL ELSE ts END AS ts FROM status_base WHERE event_type = 'signup'),
p AS (SELECT seq - 1 - k % 5 AS request, count(*) AS posts FROM status_base WHERE event_type = 'view' GROUP BY 1),
j AS (SELECT l.*, coalesce(p.posts, 0) AS posts FROM l LEFT JOIN p ON p.request = l.request),
r AS (SELECT *, CASE WHEN posts >= 2 THEN 'follow-up cap reached' WHEN ts IS NULL OR 1705300000 - ts > 604800 THEN 'follow-up window elapsed' END AS reason FROM j)
SELECT request, task, ts, posts, reason IS NULL AS due, reason FROM r"""))
def followup_due(spark: SparkSession, sf: str) -> DataFrame:
    base = view(spark, sf, "status_base")
    links = base.filter("event_type = 'signup'").select(
        F.col("seq").alias("request"), "task", F.when(F.col("k") % 12 != 0, F.col("ts")).alias("ts"))
    posts = base.filter("event_type = 'view'").select((F.col("seq") - 1 - F.col("k") % 5).alias("request"))
    return sup.followup_due(links, posts, F.lit(1705300000), cap=2)


@query("prune_ttl", with_views("""
WITH r AS (SELECT seq, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN ts + 900000 ELSE ts END AS recorded_at,
  CASE WHEN k % 7 = 0 THEN ts + 90000000 ELSE ts - k END AS mtime FROM status_base),
v AS (SELECT *, coalesce(CASE WHEN recorded_at <= 1705300000 THEN recorded_at END, CASE WHEN mtime <= 1705300000 THEN mtime END) AS recorded FROM r)
SELECT seq, recorded FROM v WHERE 1705300000 - recorded <= 400000"""))
def prune_ttl(spark: SparkSession, sf: str) -> DataFrame:
    k, ts = F.col("k"), F.col("ts")
    rows = view(spark, sf, "status_base").select(
        "seq", F.when(k % 5 == 1, ts + 900000).when(k % 5 != 0, ts).alias("recorded_at"),
        F.when(k % 7 == 0, ts + 90000000).otherwise(ts - k).alias("mtime"))
    return sup.prune_ttl(rows, F.lit(1705300000), 400000).select("seq", "recorded")
