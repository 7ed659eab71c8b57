"""Composite queries: current state, snapshot, digest, gates, commitments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import query
from tidelog.catalog.fold_queries import BUSY_SQL, OPEN_SQL
from tidelog.catalog.fold_queries import current_busy as busy_of
from tidelog.catalog.join_queries import HOMES_SQL, ROLES, RUNS_SQL, attribute_runs, backlog, roled
from tidelog.catalog.views import table, view, with_views
from tidelog.operators import folds
from tidelog.plans import snapshot as snap
from tidelog.plans import state as st

CREW = """
crew AS (SELECT c_custkey AS task, CAST(c_nationkey AS BIGINT) AS home, c_custkey AS seq,
  CASE WHEN c_custkey % 23 = 0 THEN 'home' ELSE 'ship' END AS kind, c_custkey % 31 <> 3 AS reachable FROM customer)"""


def crew(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("task"), F.col("c_nationkey").cast("long").alias("home"), key.alias("seq"),
        F.when(key % 23 == 0, "home").otherwise("ship").alias("kind"), (key % 31 != 3).alias("reachable"))


def crew_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Coarse run statuses; two of three tasks have none."""
    runs = attribute_runs(spark, sf)
    return runs.withColumn("run_status", F.when(F.col("task") % 3 == 0, F.col("run_status")))


STATE_SQL = f"""
{RUNS_SQL}, {BUSY_SQL}, {CREW},
last_line AS (SELECT task, arg_max(verb, seq) AS log_verb, arg_max(note, seq) AS log_note FROM status_events GROUP BY task),
joined AS (SELECT c.*, CASE WHEN c.task % 3 = 0 THEN a.run_status END AS run, coalesce(b.state, 'unknown') AS bs, b.source AS bsrc, l.log_verb, l.log_note,
    CASE l.log_verb WHEN 'paused' THEN 'paused' WHEN 'working' THEN 'working' WHEN 'blocked' THEN 'blocked' WHEN 'done' THEN 'done'
      WHEN 'failed' THEN 'failed' WHEN 'needs-decision' THEN 'parked' ELSE 'unknown' END AS ls
  FROM crew c LEFT JOIN attributed a ON a.task = c.task LEFT JOIN busy b ON b.task = c.task LEFT JOIN last_line l ON l.task = c.task),
judged AS (SELECT *, CASE WHEN run = 'running' THEN 'working' WHEN run = 'completed' THEN 'done' WHEN run IN ('failed', 'cancelled') THEN 'failed'
    WHEN run IS NOT NULL THEN 'unknown' END AS rs FROM joined),
states AS (SELECT task, kind, CASE WHEN run IS NOT NULL THEN rs WHEN NOT reachable THEN 'unknown' WHEN kind <> 'home' AND bs = 'busy' THEN 'working'
      WHEN kind <> 'home' AND bs <> 'idle' THEN 'unknown' WHEN log_verb IS NOT NULL AND ls <> 'unknown' THEN ls ELSE 'unknown' END AS state,
    CASE WHEN run IS NOT NULL THEN 'run-step' WHEN NOT reachable THEN 'none' WHEN kind <> 'home' AND bs <> 'idle' THEN 'pane'
      WHEN log_verb IS NOT NULL AND ls <> 'unknown' THEN 'status-log' ELSE 'none' END AS source,
    run IS NOT NULL AND coalesce(log_verb IN ('needs-decision', 'blocked'), false) AND rs <> 'parked' AS superseded, log_verb FROM judged)"""


def states_of(spark: SparkSession, sf: str) -> DataFrame:
    return st.current_state(
        crew(spark, sf), crew_runs(spark, sf), busy_of(spark, sf), view(spark, sf, "status_events"))


@query("current_state", with_views(f"WITH {STATE_SQL} SELECT task, kind, state, source, superseded FROM states"))
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    return states_of(spark, sf).select("task", "kind", "state", "source", "superseded")


@query("reconciled_open_decisions", with_views(f"""
WITH {STATE_SQL}, o AS ({OPEN_SQL})
SELECT task, key, seq, verb FROM o WHERE task NOT IN (SELECT task FROM states WHERE kind <> 'home'
  AND ((source IN ('run-step', 'pane') AND state NOT IN ('parked', 'blocked')) OR state IN ('done', 'failed')))"""))
def reconciled_open_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return st.reconciled_open_decisions(
        view(spark, sf, "status_events"), states_of(spark, sf)).select("task", "key", "seq", "verb")


@query("absorb_class", with_views(f"""
WITH {STATE_SQL}, o AS (SELECT DISTINCT task FROM ({OPEN_SQL})),
x AS (SELECT s.*, o.task IS NOT NULL AS open_one, s.task % 6 = 0 AS dead, coalesce(log_verb = 'paused', false) AS pause FROM states s LEFT JOIN o ON o.task = s.task)
SELECT task, CASE WHEN state = 'paused' THEN 'paused' WHEN state = 'working' AND source = 'run-step' AND pause AND (open_one OR dead) THEN 'paused'
  WHEN state = 'working' AND source IN ('run-step', 'pane') THEN 'working' WHEN state = 'done' AND pause THEN 'paused'
  WHEN state = 'parked' AND pause AND open_one THEN 'paused' ELSE 'none' END AS absorb FROM x"""))
def absorb_class(spark: SparkSession, sf: str) -> DataFrame:
    live = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("task"), F.when(F.col("c_custkey") % 6 == 0, "dead").otherwise("alive").alias("agent"))
    return st.absorb_class(states_of(spark, sf), view(spark, sf, "status_events"), live)


def snapshot_of(spark: SparkSession, sf: str, materialise: bool = False) -> dict[str, DataFrame]:
    """The whole snapshot, with backlog columns the tables lack filled in."""
    none = F.lit(None).cast("string")
    rows = backlog(spark, sf).withColumn("home", F.col("home").cast("long"))
    rows = rows.withColumn("completion", F.struct(F.lit("done").alias("verb"), F.col("date").alias("date")))
    for name in ("pr_url", "local_note", "blocked_reason"):
        rows = rows.withColumn(name, none)
    rows = rows.withColumn("report_path", F.when(F.col("id") % 4 == 0, F.expr("concat('data/', id, '/report.md')")))
    registry = view(spark, sf, "registry_rows")
    return snap.fleet_snapshot(
        rows, crew(spark, sf), crew_runs(spark, sf), busy_of(spark, sf), view(spark, sf, "status_events"),
        registry, view(spark, sf, "report_rows"), materialise=materialise)


SNAP_TASKS = f"""
{STATE_SQL}, {ROLES.strip()},
first_row AS (SELECT id, arg_min(role, seq) AS role, min(seq) AS first_seq FROM roled WHERE structured GROUP BY id),
live AS (SELECT c.home, c.seq, s.task AS id, s.kind, s.state, coalesce(f.role, '') AS role FROM crew c JOIN states s ON s.task = c.task LEFT JOIN first_row f ON f.id = c.task)"""


@query("snapshot_tasks", with_views(f"WITH {SNAP_TASKS} SELECT home, id, kind, state, role FROM live"))
def snapshot_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_of(spark, sf)["tasks"].select(
        "home", "id", "kind", "state", F.coalesce("backlog_role", F.lit("")).alias("role"))


@query("snapshot_homes", with_views(
    f"WITH {STATE_SQL},\n"
    "snap_tasks AS (SELECT c.home, s.task AS id, s.state FROM crew c JOIN states s ON s.task = c.task),\n"
    f"snap_open AS (SELECT c.home, o.verb FROM ({OPEN_SQL}) o JOIN crew c ON c.task = o.task WHERE o.task NOT IN (SELECT task FROM states WHERE kind <> 'home' "
    "AND ((source IN ('run-step', 'pane') AND state NOT IN ('parked', 'blocked')) OR state IN ('done', 'failed'))))\n"
    "SELECT * REPLACE (CAST(home AS BIGINT) AS home) FROM (" + HOMES_SQL.replace("task_rows", "snap_tasks").replace("FROM home_decisions", "FROM snap_open") + ")"))
def snapshot_homes(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_of(spark, sf)["homes"]


@query("snapshot_reports", with_views(f"""
WITH {CREW}, k AS (SELECT id, arg_min(kind, seq) AS kind FROM backlog_rows WHERE structured GROUP BY id)
SELECT r.id, r.path, coalesce(c.kind, k.kind, 'scout') AS kind FROM report_rows r LEFT JOIN crew c ON c.task = r.id LEFT JOIN k ON k.id = r.id"""))
def snapshot_reports(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_of(spark, sf)["reports"].select("id", "path", "kind")


@query("open_gates", with_views(f"""
WITH {ROLES}, w AS (SELECT id FROM task_rows WHERE state = 'working')
SELECT home, seq, id, CASE WHEN length(title) > 60 THEN substr(title, 1, 60) || '…' ELSE title END AS title,
  CASE WHEN unresolved <> '' THEN unresolved ELSE '-' END AS blocked_by, coalesce(hold_reason, '-') AS reason
FROM roled WHERE structured AND NOT actionable AND (state = 'queued' OR (state = 'in_flight' AND role = 'held' AND id NOT IN (SELECT id FROM w)))
  AND NOT regexp_matches(upper(body_excerpt), 'SUPERSEDED|NOT REQUIRED|NOT-REQUIRED|DEFERRED')"""))
def open_gates(spark: SparkSession, sf: str) -> DataFrame:
    working = view(spark, sf, "task_rows").filter("state = 'working'")
    rows = roled(spark, sf).withColumn("blocked_reason", F.lit(None).cast("string"))
    return snap.open_gates(rows, working)


@query("decisions_open", with_views(f"""
WITH {ROLES} SELECT home, id, concat(title, ': ', hold_reason) AS full_summary FROM roled WHERE structured AND actionable"""))
def decisions_open(spark: SparkSession, sf: str) -> DataFrame:
    rows = roled(spark, sf)
    listed = snap.actionable_decisions(rows).select("home", "id", "seq")
    return listed.join(rows.select("seq", "title", "hold_reason"), "seq").select(
        "home", "id", F.concat_ws(": ", "title", "hold_reason").alias("full_summary"))


@query("bearings", with_views(f"""
WITH {SNAP_TASKS},
landed AS (SELECT home, id, title, date FROM roled WHERE state = 'done' AND structured AND kind <> 'captain'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY coalesce(date, '') DESC, id DESC) AS rn FROM landed),
done AS (SELECT * FROM ranked WHERE rn <= 6 ORDER BY rn, home LIMIT 6),
flying AS (SELECT seq, id FROM live WHERE kind <> 'home' AND role <> 'program' AND (role <> 'held' OR state = 'working')),
decisions AS (SELECT seq, id FROM roled WHERE structured AND actionable),
gates AS (SELECT seq, id FROM roled WHERE structured AND NOT actionable AND (state = 'queued' OR (state = 'in_flight' AND role = 'held'
    AND id NOT IN (SELECT id FROM live WHERE kind <> 'home' AND state = 'working'))) AND NOT regexp_matches(upper(body_excerpt), 'SUPERSEDED|NOT REQUIRED|NOT-REQUIRED|DEFERRED')),
reports AS (SELECT id FROM report_rows WHERE id IN (SELECT id FROM live WHERE kind <> 'home') OR id IN (SELECT id FROM done)),
counts AS (SELECT 'in_flight' AS section, count(*) AS n FROM flying UNION ALL SELECT 'decisions_open', count(*) FROM decisions
  UNION ALL SELECT 'gates', count(*) FROM gates UNION ALL SELECT 'reports', count(*) FROM reports),
per_home AS (SELECT home, count(*) AS n FROM landed GROUP BY home),
orphan AS (SELECT count(*) AS n FROM roled r WHERE state = 'in_flight' AND structured AND role = 'worker' AND NOT EXISTS (SELECT 1 FROM live t WHERE t.id = r.id AND t.home = r.home))
SELECT 'landed' AS section, CAST(id AS VARCHAR) AS subject FROM done
UNION ALL SELECT 'in_flight', CAST(id AS VARCHAR) FROM (SELECT id FROM flying ORDER BY seq LIMIT 20)
UNION ALL SELECT 'decisions_open', CAST(id AS VARCHAR) FROM (SELECT id FROM decisions ORDER BY seq LIMIT 20)
UNION ALL SELECT 'gates', CAST(id AS VARCHAR) FROM (SELECT id FROM gates ORDER BY seq LIMIT 20)
UNION ALL SELECT 'reports', CAST(id AS VARCHAR) FROM (SELECT id FROM reports ORDER BY id LIMIT 20)
UNION ALL SELECT 'homes', CAST(home AS VARCHAR) FROM (SELECT DISTINCT home FROM (SELECT home FROM roled UNION SELECT home FROM live) ORDER BY home LIMIT 20)
UNION ALL SELECT 'omitted', concat('homes showing 20 of ', CAST(count(DISTINCT home) AS VARCHAR)) FROM (SELECT home FROM roled UNION SELECT home FROM live)
UNION ALL SELECT 'omitted', concat(section, ' showing 20 of ', CAST(n AS VARCHAR)) FROM counts WHERE n > 20
UNION ALL SELECT 'omitted', concat('landed showing 6 of ', CAST(sum(least(n, 6)) AS VARCHAR)) FROM per_home HAVING sum(least(n, 6)) > 6
UNION ALL SELECT 'omitted', concat('landed per-home capped at 6 for ', CAST(count(*) FILTER (WHERE n > 6) AS VARCHAR), ' home(s)') FROM per_home HAVING count(*) FILTER (WHERE n > 6) > 0
UNION ALL SELECT 'omitted', concat('in-flight backlog item(s) have no child metadata: ', CAST(n AS VARCHAR)) FROM orphan WHERE n > 0"""))
def bearings(spark: SparkSession, sf: str) -> DataFrame:
    sections = snap.bearings(snapshot_of(spark, sf, materialise=True))
    ids = {"landed": "id", "in_flight": "id", "decisions_open": "id", "gates": "id", "reports": "id", "homes": "home",
           "omitted": "surface"}
    out = None
    for name, column in ids.items():
        part = sections[name].select(F.lit(name).alias("section"), F.col(column).cast("string").alias("subject"))
        out = part if out is None else out.unionByName(part)
    return out


@query("pending_commitments", """
WITH r AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 1),
o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state,
  CASE WHEN o_orderkey % 5 = 0 THEN 'posted' WHEN o_orderkey % 5 = 1 THEN 'waived' WHEN o_orderkey % 5 = 2 THEN 'ready' END AS delivery,
  CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS platform, concat('q', CAST(o_custkey AS VARCHAR)) AS request, o_orderpriority AS p FROM orders WHERE o_orderkey % 11 <> 0)
SELECT r.id, coalesce(delivery, 'unknown') AS delivery, coalesce(platform, 'unknown') AS platform, request, concat('two ', p) AS summary
FROM r JOIN o ON o.id = r.id WHERE state <> 'done' AND coalesce(delivery, '') NOT IN ('posted', 'waived')""")
def pending_commitments(spark: SparkSession, sf: str) -> DataFrame:
    return _commitments(spark, sf)[0]


@query("unconsumed_events", """
SELECT count(*) AS unconsumed FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20))""")
def unconsumed_events(spark: SparkSession, sf: str) -> DataFrame:
    return _commitments(spark, sf)[1]


def _commitments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    obligations = table(spark, sf, "orders").filter("o_orderkey % 11 <> 0").select(
        key.alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("state"),
        F.when(key % 5 == 0, "posted").when(key % 5 == 1, "waived").when(key % 5 == 2, "ready").alias("delivery"),
        F.when(key % 3 == 0, "x").alias("platform"), F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("request"),
        F.concat(F.lit(" two \t\n "), "o_orderpriority", F.lit("\u0007 ")).alias("summary"))
    lines = table(spark, sf, "lineitem")
    registry = lines.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    events = lines.select(F.col("l_partkey").cast("string").alias("event_id"))
    consumed = table(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").cast("string").alias("event_id"))
    return snap.pending_commitments(registry, obligations, events, consumed)


@query("open_decision_report", with_views(f"""
WITH RECURSIVE o AS ({OPEN_SQL}),
l AS (SELECT seq, concat(CAST(task AS VARCHAR), CASE WHEN key = 'default' THEN '' ELSE concat(' [key=', key, ']') END, ' ', verb, ': ', note) AS line FROM o),
items AS (SELECT seq, line, length(line) + 1 AS size, row_number() OVER (ORDER BY seq) AS i FROM l),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS seq, '' AS line, false AS taken
  UNION ALL SELECT n.i, CASE WHEN w.used + n.size <= 4000 THEN w.used + n.size ELSE w.used END, n.seq, n.line, w.used + n.size <= 4000
  FROM walk w JOIN items n ON n.i = w.i + 1)
SELECT seq, line FROM walk WHERE taken"""))
def open_decision_report(spark: SparkSession, sf: str) -> DataFrame:
    return snap.open_decision_report(folds.open_decisions(view(spark, sf, "status_events"))).select("seq", "line")
