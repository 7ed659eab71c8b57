"""Joins, set operations and ledgers between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import query
from tidelog.catalog.views import table, view, with_views
from tidelog.functions import text as tx
from tidelog.operators import folds, joins, rollups, sets


def backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Backlog rows with their blockers as a nested array, roles not yet added."""
    rows = view(spark, sf, "backlog_rows")
    every_fourth = F.col("structured") & (F.col("id") % 4 == 0)
    near = F.array(F.col("id") - 1, F.col("id") - 7)
    far = F.array(F.col("id") - 1, F.col("id") - 7, F.col("id") + 900000000000)
    ids = F.when(every_fourth & (F.col("id") % 36 == 0), far).when(every_fourth, near)
    return rows.withColumn("blocked_by_ids", F.coalesce(ids, F.array().cast("array<bigint>")))


def roled(spark: SparkSession, sf: str) -> DataFrame:
    from tidelog.sources.backlog import with_roles

    return with_roles(backlog(spark, sf))


# The rows with their role, as SQL.
ROLES = """
resolved AS (SELECT id, arg_max(state = 'done', seq) AS done FROM backlog_rows WHERE structured GROUP BY id),
open_blockers AS (SELECT m.seq, m.id, m.pos, m.blocker FROM backlog_mentions m
  LEFT JOIN resolved r ON r.id = m.blocker WHERE NOT coalesce(r.done, false)),
unresolved AS (SELECT seq, string_agg(CAST(blocker AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS n
  FROM open_blockers GROUP BY seq),
roled AS (SELECT b.*, coalesce(u.ids, '') AS unresolved, coalesce(u.n, 0) > 0 AS blocked,
  CASE WHEN NOT structured THEN NULL
       WHEN state = 'in_flight' AND hold_reason IS NOT NULL AND hold_kind IS NOT NULL THEN 'held'
       WHEN state = 'in_flight' AND kind = 'program' THEN 'program' WHEN state = 'in_flight' THEN 'worker'
       WHEN state = 'queued' THEN 'queued' ELSE 'done' END AS role,
  structured AND state = 'queued' AND kind = 'captain' AND coalesce(hold_kind = 'captain', false)
    AND hold_reason IS NOT NULL AND u.seq IS NULL AS actionable
  FROM backlog_rows b LEFT JOIN unresolved u ON u.seq = b.seq)"""


@query("attach_backlog", with_views("""
WITH f AS (SELECT id, min(seq) AS seq, arg_min(title, seq) AS title, arg_min(state, seq) AS state
  FROM backlog_rows WHERE structured GROUP BY id)
SELECT t.id, t.state, f.seq AS backlog_seq, f.title AS backlog_title, f.state AS backlog_state
FROM task_rows t LEFT JOIN f ON f.id = t.id"""))
def attach_backlog(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "backlog_rows").select("id", "seq", "structured", "title", "state")
    return joins.attach_backlog(view(spark, sf, "task_rows").select("id", "state"), rows)


_REGISTRY = """
WITH t AS (SELECT CAST(home AS BIGINT) AS id, min(seq) AS task_seq, concat('/work/', CAST(min(home) AS VARCHAR)) AS home
  FROM task_rows GROUP BY home)
SELECT coalesce(r.id, t.id) AS id, coalesce(r.home, t.home) AS home,
  CASE WHEN r.id IS NOT NULL THEN true ELSE {outside} END AS registered,
  CASE WHEN r.id IS NOT NULL THEN r.registry_error ELSE '{why}' END AS registry_error, t.task_seq
FROM registry_rows r FULL JOIN t ON t.id = r.id"""


def _registry_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "task_rows").select(
        F.col("home").cast("long").alias("id"), "seq",
        F.concat(F.lit("/work/"), F.col("home").cast("string")).alias("home"))


@query("union_registry", with_views(_REGISTRY.format(outside="false", why="task metadata is not registered")))
def union_registry(spark: SparkSession, sf: str) -> DataFrame:
    return joins.union_registry(view(spark, sf, "registry_rows"), _registry_tasks(spark, sf), True)


@query("union_registry_incomplete", with_views(_REGISTRY.format(
    outside="NULL", why="registration is unknown because the registry read is incomplete or unavailable")))
def union_registry_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return joins.union_registry(view(spark, sf, "registry_rows"), _registry_tasks(spark, sf), False)


@query("orphans", with_views(f"""
WITH {ROLES}, owned AS (SELECT id, role FROM roled WHERE state = 'in_flight' AND structured)
SELECT id, 'orphan_in_flight' AS kind FROM owned WHERE role = 'worker' AND id NOT IN (SELECT id FROM task_rows)
UNION ALL SELECT id, 'unowned_current' AS kind FROM task_rows WHERE id NOT IN (SELECT id FROM owned)"""))
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return joins.orphans(roled(spark, sf), view(spark, sf, "task_rows"))


@query("terminal_in_flight", with_views("""
SELECT b.id, b.seq, t.state AS task_state FROM backlog_rows b JOIN task_rows t ON t.id = b.id
WHERE b.state = 'in_flight' AND b.structured AND t.state IN ('done', 'failed')"""))
def terminal_in_flight(spark: SparkSession, sf: str) -> DataFrame:
    return joins.owned_with_state(
        view(spark, sf, "backlog_rows"), view(spark, sf, "task_rows"), ("done", "failed"))


@query("unresolved_blockers", with_views(f"""
WITH {ROLES} SELECT seq, id, unresolved FROM roled WHERE structured"""))
def unresolved_blockers(spark: SparkSession, sf: str) -> DataFrame:
    return joins.unresolved_blockers(backlog(spark, sf)).select(
        "seq", "id", F.array_join("unresolved", ",").alias("unresolved"))


@query("relevant_reports", with_views("""
SELECT id, path FROM report_rows WHERE id IN (SELECT id FROM task_rows WHERE kind <> 'home')
   OR id IN (SELECT id FROM backlog_base WHERE state = 'done' AND structured AND kind <> 'captain')"""))
def relevant_reports(spark: SparkSession, sf: str) -> DataFrame:
    live = view(spark, sf, "task_rows").filter("kind <> 'home'")
    landed = view(spark, sf, "backlog_base").filter("state = 'done' AND structured AND kind <> 'captain'")
    return joins.relevant_reports(view(spark, sf, "report_rows"), live, landed)


def claim_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims from the logs, surfaces from supplier and customer rows, completeness per home."""
    logs = view(spark, sf, "status_events")
    claims = logs.filter("verb IN ('working', 'paused', 'needs-decision', 'blocked', 'done')").select(
        (F.col("task") % 25).alias("home"), F.when(F.col("k") % 10 == 0, F.lit("default"))
        .otherwise(F.concat(F.lit("c"), (F.col("k") % 60).cast("string"))).alias("key"), "verb").distinct()
    number = F.col("c_custkey") % 3
    ident = F.concat(F.lit("c"), (F.col("c_custkey") % 70).cast("string"))
    sections = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("long").alias("home"),
        F.when(number == 0, "active_children").when(number == 1, "holds").otherwise("decisions_open").alias("surface"),
        F.col("c_custkey").alias("seq"), ident.alias("id"),
        F.concat(F.lit("c"), (F.col("c_custkey") % 11).cast("string")).alias("key"),
        F.when(F.col("c_custkey") % 2 == 0, "needs-decision").otherwise("blocked").alias("verb"),
        F.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("c"), (F.col("c_custkey") % 13).cast("string"))).alias("blocked_by"))
    complete = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("home"), (F.col("n_nationkey") % 2 == 0).alias("active_children"),
        (F.col("n_nationkey") % 3 == 0).alias("holds"), (F.col("n_nationkey") % 5 != 0).alias("decisions_open"))
    return claims, sections, complete


@query("reconcile_claims", with_views("""
WITH claims AS (SELECT DISTINCT task % 25 AS home, CASE WHEN k % 10 = 0 THEN 'default' ELSE concat('c', CAST(k % 60 AS VARCHAR)) END AS key, verb
  FROM status_events WHERE verb IN ('working', 'paused', 'needs-decision', 'blocked', 'done')),
s AS (SELECT c_nationkey AS home, c_custkey AS seq, c_custkey % 3 AS t, concat('c', CAST(c_custkey % 70 AS VARCHAR)) AS id,
  concat('c', CAST(c_custkey % 11 AS VARCHAR)) AS key, c_custkey % 2 = 0 AS needs,
  CASE WHEN c_custkey % 4 = 1 THEN concat('c', CAST(c_custkey % 13 AS VARCHAR)) END AS blocked_by FROM customer),
m AS (SELECT home, 'working' AS verb, id AS key, seq, 0 AS late, id FROM s WHERE t = 0
  UNION ALL SELECT home, 'needs-decision', key, seq, 0, id FROM s WHERE t = 2 AND needs
  UNION ALL SELECT home, 'paused', id, seq, 1, id FROM s WHERE t = 1
  UNION ALL SELECT home, 'paused', blocked_by, seq, 1, id FROM s WHERE t = 1 AND blocked_by IS NOT NULL
  UNION ALL SELECT home, 'blocked', id, seq, 1, id FROM s WHERE t = 1
  UNION ALL SELECT home, 'blocked', blocked_by, seq, 1, id FROM s WHERE t = 1 AND blocked_by IS NOT NULL
  UNION ALL SELECT home, 'blocked', key, seq, 0, id FROM s WHERE t = 2 AND NOT needs
  UNION ALL SELECT home, 'blocked', id, seq, 0, id FROM s WHERE t = 2 AND NOT needs),
f AS (SELECT home, verb, key, arg_min(id, late * 1000000000000 + seq) AS matched FROM m GROUP BY home, verb, key)
SELECT c.home, c.verb, c.key, CASE WHEN c.verb = 'done' OR c.key = 'default' THEN 'inconclusive'
    WHEN f.matched IS NOT NULL THEN 'corroborates'
    WHEN (c.verb = 'working' AND c.home % 2 = 0) OR (c.verb = 'paused' AND c.home % 3 = 0)
      OR (c.verb = 'needs-decision' AND c.home % 5 <> 0) OR (c.verb = 'blocked' AND c.home % 5 <> 0 AND c.home % 3 = 0)
    THEN 'contradicts' ELSE 'inconclusive' END AS verdict,
  CASE c.verb WHEN 'working' THEN 'active_children' WHEN 'paused' THEN 'holds' WHEN 'needs-decision' THEN 'decisions_open'
    WHEN 'blocked' THEN 'decisions_open_or_holds' END AS compared_to,
  CASE WHEN c.key <> 'default' THEN f.matched END AS matched
FROM claims c LEFT JOIN f ON f.home = c.home AND f.verb = c.verb AND f.key = c.key"""))
def reconcile_claims(spark: SparkSession, sf: str) -> DataFrame:
    claims, sections, complete = claim_tables(spark, sf)
    return joins.reconcile_claims(claims, sections, complete)


@query("resolve_requests", with_views("""
WITH l AS (SELECT seq, line, lower(regexp_extract(line, 'corr=([A-Fa-f0-9]{16})', 1)) AS corr FROM report_lines
  WHERE regexp_matches(line, 'corr=[A-Fa-f0-9]{16}') AND NOT contains(line, 'pending-reply-missed')),
a AS (SELECT r.corr, min(l.seq) AS answer_seq, arg_min(l.line, l.seq) AS line FROM requests r JOIN l ON l.corr = r.corr AND l.seq > r.seq GROUP BY r.corr)
SELECT r.corr, r.seq, a.answer_seq, CASE WHEN a.line IS NULL THEN NULL
  WHEN contains(a.line, 'report.md') THEN 'document' WHEN contains(a.line, 'via-helper') THEN 'helper' ELSE 'status' END AS via
FROM requests r LEFT JOIN a ON a.corr = r.corr"""))
def resolve_requests(spark: SparkSession, sf: str) -> DataFrame:
    requests = view(spark, sf, "requests").select("corr", "seq")
    return joins.resolve_requests(requests, view(spark, sf, "report_lines").select("seq", "line"))


def run_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf, "lineitem")
    branch = (F.col("l_orderkey") % 1999).alias("branch")
    place = F.col("l_partkey") * 100000000 + F.col("l_orderkey") * 8 + F.col("l_linenumber")
    status = (F.when(F.col("l_partkey") % 9 == 0, "running").when(F.col("l_returnflag") == "R", "failed")
              .otherwise("completed"))
    head = (F.when(F.col("l_suppkey") % 7 == 0, "match").when(F.col("l_suppkey") % 7 == 1, "unresolvable")
            .otherwise("diverged"))
    runs = part.select((F.col("l_suppkey") % 5).alias("repo"), branch, place.alias("pos"), status.alias("status"),
                       head.alias("head"))
    tasks = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("task"), (F.col("o_orderkey") % 5).alias("repo"),
        (F.col("o_orderkey") % 1999).alias("branch"), (F.col("o_orderkey") % 2 == 0).alias("allow_unresolvable"))
    listings = table(spark, sf, "region").select(
        F.col("r_regionkey").cast("long").alias("repo"), (F.col("r_regionkey") == 3).alias("tainted"),
        (F.col("r_regionkey") == 2).alias("incomplete"))
    return tasks, runs, listings


RUNS_SQL = """
runs AS (SELECT l_suppkey % 5 AS repo, l_orderkey % 1999 AS branch, l_partkey * 100000000 + l_orderkey * 8 + l_linenumber AS pos,
  CASE WHEN l_partkey % 9 = 0 THEN 'running' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN l_suppkey % 7 = 0 THEN 'match' WHEN l_suppkey % 7 = 1 THEN 'unresolvable' ELSE 'diverged' END AS head FROM lineitem),
b AS (SELECT repo, branch, arg_min(status, pos) FILTER (WHERE head = 'match') AS matched, count(*) FILTER (WHERE status = 'running') AS live,
  arg_max(head, pos) FILTER (WHERE status = 'running') AS live_head FROM runs GROUP BY repo, branch),
attributed AS (SELECT o_orderkey AS task, CASE WHEN o_orderkey % 5 <> 3 THEN coalesce(matched, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 2
  AND live = 1 AND live_head = 'unresolvable' THEN 'running' END) END AS run_status
FROM orders LEFT JOIN b ON b.repo = o_orderkey % 5 AND b.branch = o_orderkey % 1999)"""


@query("attribute_runs", f"WITH {RUNS_SQL} SELECT task, run_status FROM attributed")
def attribute_runs(spark: SparkSession, sf: str) -> DataFrame:
    return joins.attribute_runs(*run_tables(spark, sf))


SURFACED = """surfaced AS (SELECT task, arg_max(line, seq) AS line FROM status_events WHERE k % 4 <> 0 GROUP BY task)"""


@query("unsurfaced", with_views(f"""
WITH c AS (SELECT task, arg_max(line, seq) AS line, arg_max(verb, seq) AS verb, max(seq) AS seq FROM status_events GROUP BY task), {SURFACED}
SELECT c.task, c.seq, c.line FROM c LEFT JOIN surfaced s ON s.task = c.task
WHERE c.verb IN ('done', 'needs-decision', 'blocked', 'failed') AND c.line IS DISTINCT FROM s.line"""))
def unsurfaced(spark: SparkSession, sf: str) -> DataFrame:
    logs = view(spark, sf, "status_events")
    last = folds.latest_event(logs, ["verb", "line"])
    relevant = last.filter(tx.is_relevant(F.col("verb"), F.col("line")))
    surfaced = folds.latest_event(logs.filter("k % 4 <> 0"), ["line"])
    return joins.unsurfaced(relevant, surfaced).select("task", "seq", "line")


def result_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    logs = view(spark, sf, "status_events")
    results = logs.filter("event_type = 'click'").select(
        F.col("task").alias("source"), "seq", F.concat(F.col("task").cast("string"), F.lit("."), F.col("seq").cast("string"), F.lit(".result")).alias("path"))
    handled = logs.filter("event_type = 'click' AND k % 3 = 0").select(F.col("task").alias("source"), "seq")
    return results, handled


@query("pending_results", with_views("""
SELECT task AS source, seq, concat(CAST(task AS VARCHAR), '.', CAST(seq AS VARCHAR), '.result') AS path
FROM status_events WHERE event_type = 'click' AND k % 3 <> 0"""))
def pending_results(spark: SparkSession, sf: str) -> DataFrame:
    return joins.pending_results(*result_tables(spark, sf))


@query("coalesce_sources", """
SELECT o_orderkey AS request,
  coalesce(CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 = 0 THEN 'x' END, CASE WHEN o_orderkey % 3 = 0 THEN 'discord' END,
           'x') AS platform,
  coalesce(CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END,
           CASE WHEN o_orderkey % 3 = 0 THEN '280' END, '500') AS max_chars
FROM orders""")
def coalesce_sources(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), "o_custkey")
    key = F.col("request")
    registry = o.filter("request % 2 = 0").select(
        "request", F.when(key % 4 == 0, "x").otherwise("fax").alias("platform"),
        F.when(key % 10 == 0, "many").otherwise(F.col("o_custkey").cast("string")).alias("max_chars"))
    inbox = o.filter("request % 3 = 0").select(
        "request", F.lit("discord").alias("platform"), F.lit("280").alias("max_chars"))
    relay = o.select("request", F.lit("x").alias("platform"), F.lit("500").alias("max_chars"))
    valid = {"platform": F.col("platform").isin("discord", "x"), "max_chars": F.col("max_chars").rlike("^[0-9]+$")}
    return joins.coalesce_sources(o.select("request"), [registry, inbox, relay], "request", valid)


@query("sync_diff", """
WITH p AS (SELECT p_partkey AS item, md5(p_name) AS d FROM part WHERE p_partkey % 7 <> 0),
r AS (SELECT s_suppkey % 10 AS target, p_partkey AS item, md5(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END) AS d
  FROM part JOIN supplier ON s_suppkey < 10 WHERE p_partkey % 5 <> 0),
u AS (SELECT s_suppkey AS target, p_partkey AS item, p_partkey % 11 = 0 AS scoped, (p_partkey + s_suppkey) % 13 <> 0 AS allowed
  FROM part JOIN supplier ON s_suppkey < 10)
SELECT u.target, u.item, CASE WHEN scoped THEN 'scoped-out' WHEN (p.d IS NOT NULL OR r.d IS NOT NULL) AND NOT allowed THEN 'skipped'
  WHEN p.d IS NOT NULL AND p.d IS DISTINCT FROM r.d THEN 'pushed' WHEN p.d IS NULL AND r.d IS NOT NULL THEN 'mirrored-absence'
  ELSE 'unchanged' END AS action
FROM u LEFT JOIN p ON p.item = u.item LEFT JOIN r ON r.item = u.item AND r.target = u.target""")
def sync_diff(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    item = F.col("p_partkey")
    primary = part.filter("p_partkey % 7 <> 0").select(item.alias("item"), F.md5("p_name").alias("digest"))
    # Ten targets, a fixed number: every item of every target is one rule row.
    per_target = part.withColumn("target", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    replica = per_target.filter("p_partkey % 5 <> 0").select(
        "target", item.alias("item"), F.md5(F.when(item % 3 == 0, F.col("p_type")).otherwise(F.col("p_name"))).alias("digest"))
    rules = per_target.select(
        "target", item.alias("item"), (item % 11 == 0).alias("session_scoped"),
        ((item + F.col("target")) % 13 != 0).alias("allowed"))
    return joins.sync_diff(primary, replica, rules)


@query("classify_retention", """
SELECT p_partkey AS name, CASE WHEN p_partkey % 41 = 0 THEN 'protected'
  WHEN p_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0) THEN 'live-owner'
  WHEN p_partkey % 37 = 0 THEN 'outside-root' WHEN p_size * 3600 < 86400 THEN 'too-fresh'
  WHEN p_partkey % 10 = 3 THEN 'in-use' ELSE 'stale' END AS verdict FROM part""")
def classify_retention(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    inventory = table(spark, sf, "part").select(
        key.alias("name"), key.alias("owner"), (F.col("p_size") * 3600).alias("age_secs"),
        (key % 37 != 0).alias("inside_root"), (key % 10 == 3).alias("in_use"))
    live = table(spark, sf, "orders").filter("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("id"))
    return joins.classify_retention(inventory, live, F.col("name") % 41 == 0, 86400).select("name", "verdict")


@query("inventory_validity", with_views(f"""
WITH {ROLES}, o AS (SELECT r.home, count(*) AS n FROM roled r WHERE state = 'in_flight' AND structured AND role = 'worker'
  AND NOT EXISTS (SELECT 1 FROM task_rows t WHERE t.id = r.id AND t.home = r.home) GROUP BY r.home),
u AS (SELECT home, CAST(sum(CASE WHEN state IN ('in_flight', 'queued') AND NOT structured THEN 1 ELSE 0 END) AS BIGINT) AS unstructured FROM roled GROUP BY home)
SELECT u.home, unstructured, coalesce(o.n, 0) AS orphans, unstructured = 0 AND o.n IS NULL AS valid,
  CASE WHEN unstructured > 0 THEN 'unstructured current backlog row' WHEN o.n > 0 THEN 'in-flight backlog item has no child metadata' END AS reason
FROM u LEFT JOIN o ON o.home = u.home"""))
def inventory_validity(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.inventory_validity(roled(spark, sf), view(spark, sf, "task_rows"))


HOME_DECISIONS = """home_decisions AS (SELECT task % 25 AS home, key, verb FROM (
  SELECT task, key, arg_max(verb, seq) AS verb FROM status_events
  WHERE verb IN ('needs-decision', 'blocked', 'resolved', 'captain-held')
    AND (NOT starts_with(key, 'pending-reply-') OR starts_with(note, 'pending-reply-missed:'))
  GROUP BY task, key) WHERE verb IN ('needs-decision', 'blocked'))"""

HOMES_SQL = f"""
WITH {ROLES}, {HOME_DECISIONS},
j AS (SELECT r.*, t.state AS t_state, t.id AS t_id, hold_reason IS NOT NULL AND hold_kind IS NOT NULL AS held
  FROM roled r LEFT JOIN task_rows t ON t.id = r.id AND t.home = r.home),
q AS (SELECT *, structured AND (state = 'queued' OR (state = 'in_flight' AND role = 'held' AND coalesce(t_state, '') <> 'working')) AS queued_row,
  state = 'in_flight' AND structured AS owned FROM j),
b AS (SELECT home, count(*) FILTER (WHERE state IN ('in_flight', 'queued') AND NOT structured) AS unstructured,
  count(*) FILTER (WHERE owned AND role = 'worker' AND t_id IS NULL) AS orphan,
  count(*) FILTER (WHERE owned AND t_state IN ('done', 'failed')) AS terminal,
  count(*) FILTER (WHERE owned AND role <> 'program' AND t_state = 'working') AS active_children,
  count(*) FILTER (WHERE queued_row) AS queued, count(*) FILTER (WHERE queued_row AND actionable) AS captain_holds,
  count(*) FILTER (WHERE queued_row AND (blocked OR held)) + count(*) FILTER (WHERE owned AND t_state IN ('parked', 'paused', 'blocked') AND NOT held) AS holds,
  count(*) FILTER (WHERE state = 'done' AND structured AND kind <> 'captain') AS landed FROM q GROUP BY home),
k AS (SELECT t.home, count(*) AS endpoints, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM roled r WHERE r.id = t.id AND r.home = t.home AND r.state = 'in_flight' AND r.structured)) AS unowned,
  count(*) FILTER (WHERE t.state = 'unknown') AS unknown_children FROM task_rows t GROUP BY t.home),
d AS (SELECT home, count(*) AS n, count(*) FILTER (WHERE verb = 'needs-decision') AS needs FROM home_decisions GROUP BY home),
r AS (SELECT b.*, coalesce(k.endpoints, 0) AS endpoints, coalesce(d.n, 0) AS dn, coalesce(d.needs, 0) AS needs,
  CASE WHEN unstructured > 0 THEN 'unstructured current backlog row' WHEN orphan > 0 THEN 'in-flight backlog item has no child metadata'
    WHEN coalesce(unowned, 0) > 0 THEN 'live child state has no in-flight backlog item' WHEN terminal > 0 THEN 'in-flight backlog item has terminal child state'
    WHEN coalesce(unknown_children, 0) > 0 THEN 'child current state unavailable' END AS reason
  FROM b LEFT JOIN k ON k.home = b.home LEFT JOIN d ON d.home = b.home)
SELECT home, reason IS NULL AS valid, reason, CASE WHEN reason IS NOT NULL THEN 'unknown' WHEN needs + captain_holds > 0 THEN 'captain_decision'
  WHEN active_children > 0 THEN 'active_child_work' WHEN holds > 0 THEN 'externally_held' ELSE 'no_active_work' END AS state,
  active_children, captain_holds + dn AS decisions_open, holds, queued, landed, endpoints FROM r"""


@query("home_summary", with_views(HOMES_SQL))
def home_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = roled(spark, sf).withColumn("blocked", F.coalesce(F.size("unresolved") > 0, F.lit(False)))
    decisions = folds.open_decisions(view(spark, sf, "status_events")).withColumn(
        "home", (F.col("task") % 25).cast("int"))
    return rollups.home_summary(rows, view(spark, sf, "task_rows"), decisions)


@query("home_invalidities", with_views("""
WITH t AS (SELECT id % 40000 AS home, id, state FROM task_rows),
b AS (SELECT id % 40000 AS home, id, state FROM backlog_base WHERE structured AND id % 3 <> 0),
o AS (SELECT home, id FROM b WHERE state = 'in_flight'),
x AS (SELECT t.home, t.id, t.state, o.id IS NOT NULL AS owned FROM t LEFT JOIN o ON o.home = t.home AND o.id = t.id)
SELECT home, 'unowned_current' AS kind, id FROM x WHERE NOT owned
UNION ALL SELECT home, 'terminal_in_flight', id FROM x WHERE owned AND state IN ('done', 'failed')
UNION ALL SELECT home, 'child_current_unavailable', id FROM x WHERE state = 'unknown'"""))
def home_invalidities(spark: SparkSession, sf: str) -> DataFrame:
    group = (F.col("id") % 40000).alias("home")
    rows = view(spark, sf, "backlog_base").filter("structured AND id % 3 <> 0").select(
        group, "id", "state", "structured", (F.lit(False)).alias("requires_child"))
    tasks = view(spark, sf, "task_rows").select(group, "id", "state")
    return rollups.home_invalidities(rows, tasks)


@query("partition_audit", with_views("""
WITH parts AS (SELECT lane AS shard, path AS item FROM timings WHERE duration_ms % 101 <> 0
  UNION ALL SELECT lane, concat(path, '-x') FROM timings WHERE duration_ms % 211 = 0
  UNION ALL SELECT 'Brand#1', path FROM timings WHERE duration_ms % 97 = 0),
inv AS (SELECT path AS item FROM timings),
g AS (SELECT item, count(*) AS rows, count(DISTINCT shard) AS shards FROM parts GROUP BY item),
m AS (SELECT item, max(n) AS most FROM (SELECT item, shard, count(*) AS n FROM parts GROUP BY item, shard) z GROUP BY item)
SELECT 'missing' AS violation, item AS subject FROM inv WHERE item NOT IN (SELECT item FROM parts)
UNION ALL SELECT 'extra', item FROM g WHERE item NOT IN (SELECT item FROM inv)
UNION ALL SELECT 'overlap', item FROM g WHERE shards > 1
UNION ALL SELECT 'duplicate', item FROM m WHERE most > 1
UNION ALL SELECT 'empty', concat('Brand#', CAST(r_regionkey * 20 AS VARCHAR)) FROM region WHERE concat('Brand#', CAST(r_regionkey * 20 AS VARCHAR)) NOT IN (SELECT shard FROM parts)"""))
def partition_audit(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "timings")
    parts = t.filter("duration_ms % 101 <> 0").select(F.col("lane").alias("shard"), F.col("path").alias("item"))
    parts = parts.unionByName(t.filter("duration_ms % 211 = 0").select(
        F.col("lane").alias("shard"), F.concat("path", F.lit("-x")).alias("item")))
    parts = parts.unionByName(t.filter("duration_ms % 97 = 0").select(
        F.lit("Brand#1").alias("shard"), F.col("path").alias("item")))
    shards = table(spark, sf, "region").select(
        F.concat(F.lit("Brand#"), (F.col("r_regionkey") * 20).cast("string")).alias("shard"))
    return sets.partition_audit(parts, t.select(F.col("path").alias("item")), shards)


@query("merge_evidence", with_views("""
SELECT task, note FROM status_events WHERE verb = 'blocked' AND k < 60
UNION SELECT task, note FROM status_events WHERE verb = 'blocked' AND k > 30"""))
def merge_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "status_events").filter("verb = 'blocked'").select("task", "note", "k")
    return sets.merge_evidence(rows.filter("k < 60").drop("k"), rows.filter("k > 30").drop("k"))


@query("landed_union", with_views("""
SELECT id, title, date, CASE WHEN home = 0 THEN '(main)' ELSE CAST(home AS VARCHAR) END AS home,
  CASE WHEN home = 0 THEN 'main' ELSE 'home' END AS origin
FROM backlog_base WHERE state = 'done' AND structured AND kind <> 'captain'"""))
def landed_union(spark: SparkSession, sf: str) -> DataFrame:
    done = view(spark, sf, "backlog_base").filter("state = 'done' AND structured AND kind <> 'captain'")
    main = done.filter("home = 0").select("id", "title", "date")
    others = done.filter("home <> 0").select("id", "title", "date", F.col("home").cast("string").alias("home"))
    return sets.landed_union(main, others)


@query("inventory_diff", """
WITH d AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_partkey % 3 <> 0 UNION SELECT -p_partkey FROM part WHERE p_size = 7),
t AS (SELECT p_partkey AS item FROM part)
SELECT item, 'missing' AS kind FROM t WHERE item NOT IN (SELECT item FROM d)
UNION ALL SELECT item, 'extra' FROM d WHERE item NOT IN (SELECT item FROM t)""")
def inventory_diff(spark: SparkSession, sf: str) -> DataFrame:
    declared = table(spark, sf, "lineitem").filter("l_partkey % 3 <> 0").select(F.col("l_partkey").alias("item"))
    gone = table(spark, sf, "part").filter("p_size = 7").select((-F.col("p_partkey")).alias("item"))
    tracked = table(spark, sf, "part").select(F.col("p_partkey").alias("item"))
    return sets.inventory_diff(declared.unionByName(gone), tracked)
