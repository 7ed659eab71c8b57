"""Folds and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import query
from tidelog.catalog.views import table, view, with_views
from tidelog.functions import text as tx
from tidelog.operators import folds, rollups

OPEN_SQL = """
SELECT task, key, seq, verb, note FROM (
  SELECT task, key, max(seq) AS seq, arg_max(verb, seq) AS verb, arg_max(note, seq) AS note FROM status_events
  WHERE verb IN ('needs-decision', 'blocked', 'resolved', 'captain-held')
    AND (NOT starts_with(key, 'pending-reply-') OR starts_with(note, 'pending-reply-missed:'))
  GROUP BY task, key)
WHERE verb IN ('needs-decision', 'blocked')"""


@query("open_decisions", with_views(OPEN_SQL))
def open_decisions(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "status_events").select("task", "seq", "line")
    return folds.open_decisions(tx.parse_status(lines)).select("task", "key", "seq", "verb", "note")


@query("open_decisions_by_task", with_views(f"""
SELECT task, count(*) AS open_keys, max(seq) AS newest FROM ({OPEN_SQL}) GROUP BY task"""))
def open_decisions_by_task(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "status_events").select("task", "seq", "line")
    return folds.open_decisions(tx.parse_status(lines)).groupBy("task").agg(
        F.count("*").alias("open_keys"), F.max("seq").alias("newest"))


@query("open_activities", with_views("""
SELECT task, key, seq, verb, note FROM (
  SELECT task, key, max(seq) AS seq, arg_max(verb, seq) AS verb, arg_max(note, seq) AS note FROM status_events
  WHERE verb IN ('working', 'paused', 'done', 'failed', 'needs-decision', 'blocked', 'resolved', 'captain-held')
  GROUP BY task, key)
WHERE verb IN ('working', 'paused')"""))
def open_activities(spark: SparkSession, sf: str) -> DataFrame:
    return folds.open_activities(view(spark, sf, "status_events")).select("task", "key", "seq", "verb", "note")


@query("latest_event", with_views("""
SELECT task, max(seq) AS seq, arg_max(verb, seq) AS verb, arg_max(line, seq) AS line
FROM status_events GROUP BY task"""))
def latest_event(spark: SparkSession, sf: str) -> DataFrame:
    return folds.latest_event(view(spark, sf, "status_events"), ["verb", "line"]).select(
        "task", "seq", "verb", "line")


@query("open_blockers", with_views(f"""
SELECT task, key, seq, note FROM ({OPEN_SQL}) o
WHERE verb = 'blocked' AND task IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)"""))
def open_blockers(spark: SparkSession, sf: str) -> DataFrame:
    live = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("task"))
    return folds.open_blockers(view(spark, sf, "status_events"), live).select("task", "key", "seq", "note")


@query("uncovered_decisions", with_views(f"""
SELECT o.task, o.key FROM ({OPEN_SQL}) o ANTI JOIN
  (SELECT DISTINCT task, key FROM status_events WHERE k % 4 = 2 AND event_type = 'view') i
  ON o.task = i.task AND o.key = i.key"""))
def uncovered_decisions(spark: SparkSession, sf: str) -> DataFrame:
    logs = view(spark, sf, "status_events")
    inventory = logs.filter("k % 4 = 2 AND event_type = 'view'")
    return folds.uncovered_decisions(folds.open_decisions(logs), inventory).select("task", "key")


@query("run_state", with_views("""
WITH r AS (SELECT task, run_id, arg_max(event, seq) AS final, bool_or(event = 'started') AS seen
  FROM run_steps WHERE event IN ('started', 'terminal') GROUP BY task, run_id),
l AS (SELECT task, bool_or(seen) AS seen, bool_or(final = 'started') AS busy FROM r GROUP BY task)
SELECT t.task, CASE WHEN NOT coalesce(l.seen, false) THEN 'none' WHEN l.busy THEN 'busy' ELSE 'settled' END AS run_state
FROM (SELECT DISTINCT task FROM run_steps) t LEFT JOIN l ON l.task = t.task"""))
def run_state(spark: SparkSession, sf: str) -> DataFrame:
    return folds.run_state(view(spark, sf, "run_steps"))


BUSY_SQL = """
armed AS (SELECT user_id AS task,
    CASE WHEN user_id % 9 = 4 THEN NULL WHEN user_id % 9 = 5 THEN 'g0' ELSE
      concat('g', CAST(CAST(floor(max(event_id) / 1000.0) AS BIGINT) AS VARCHAR)) END AS gen,
    CASE WHEN user_id % 5 = 0 THEN 'other' ELSE 'main' END AS producer FROM events GROUP BY user_id
  UNION ALL SELECT -1, 'g0', 'main'),
busy_cur AS (SELECT task, arg_max(gen, seq) AS gen, arg_max(record_seq, seq) AS rs, arg_max(state, seq) AS state,
    arg_max(source, seq) AS source, arg_max(event, seq) AS event FROM busy_records GROUP BY task),
busy_j AS (SELECT a.task, a.gen AS ag, a.producer, c.gen, c.state, c.source, c.task IS NOT NULL AS present,
    regexp_matches(c.rs, '^[0-9]+$') AND c.state IN ('busy', 'idle', 'unknown') AS ok FROM armed a LEFT JOIN busy_cur c ON c.task = a.task),
busy_r AS (SELECT task, state, source, CASE WHEN NOT present THEN 'missing' WHEN ag IS NULL OR NOT ok THEN 'malformed'
    WHEN gen <> ag THEN 'gen-mismatch'
    WHEN NOT ((producer = 'main' AND source = 'main-hook') OR (producer = 'other' AND source = 'other-hook')) THEN 'source-mismatch' END AS reason FROM busy_j),
busy AS (SELECT task, CASE WHEN reason IS NULL THEN state ELSE 'unknown' END AS state, coalesce(reason, source) AS source FROM busy_r)"""


@query("current_busy", with_views(f"WITH {BUSY_SQL} SELECT * FROM busy"))
def current_busy(spark: SparkSession, sf: str) -> DataFrame:
    task = F.col("user_id").alias("task")
    newest = F.concat(F.lit("g"), F.floor(F.max("event_id") / 1000).cast("long").cast("string"))
    gen = F.when(F.col("user_id") % 9 == 4, None).when(F.col("user_id") % 9 == 5, "g0").otherwise(F.col("newest"))
    per_task = table(spark, sf, "events").groupBy("user_id").agg(newest.alias("newest"))
    armed = per_task.select(
        task, gen.alias("gen"), F.when(F.col("user_id") % 5 == 0, "other").otherwise("main").alias("producer"))
    silent = spark.range(1).select(
        F.lit(-1).cast("long").alias("task"), F.lit("g0").alias("gen"), F.lit("main").alias("producer"))
    trust = spark.createDataFrame([("main", "main-hook"), ("other", "other-hook")], "producer string, source string")
    return folds.current_busy(view(spark, sf, "busy_records"), armed.unionByName(silent), trust)


# The same text in both engines: whole records, and each way in which one can be broken.
BUSY_TEXT = """CASE seq % 12 WHEN 0 THEN concat('garbage', chr(10)) WHEN 1 THEN concat('v0 ', body, chr(10))
  WHEN 2 THEN concat('v1 ', body, ' rogue=1', chr(10)) WHEN 3 THEN concat('v1 ', body, chr(10), 'second line', chr(10))
  WHEN 4 THEN concat('v1 ', body) WHEN 5 THEN concat('  v1   ', body, '  state=unknown', chr(10))
  WHEN 6 THEN concat('v1 ', body, ' source=bad source', chr(10)) WHEN 7 THEN concat('v1 state=idle', chr(10))
  ELSE concat('v1 ', body, chr(10)) END"""
BUSY_BODY = """concat('gen=', gen, ' seq=', record_seq, ' state=', state, ' source=', source, ' event=', event, ' ts=', ts)"""


@query("busy_lines", with_views(f"""
WITH t AS (SELECT task, seq, {BUSY_BODY} AS body FROM busy_records), r AS (SELECT task, seq, {BUSY_TEXT} AS record FROM t),
p AS (SELECT *, list_filter(string_split(split_part(record, chr(10), 1), ' '), lambda x: x <> '') AS parts FROM r),
v AS (SELECT task, seq, record, parts[1] AS ver, parts[2:] AS given FROM p),
f AS (SELECT *, substr(list_filter(given, lambda x: starts_with(x, 'gen='))[-1], 5) AS gen, substr(list_filter(given, lambda x: starts_with(x, 'seq='))[-1], 5) AS rs,
  substr(list_filter(given, lambda x: starts_with(x, 'state='))[-1], 7) AS state, substr(list_filter(given, lambda x: starts_with(x, 'source='))[-1], 8) AS source,
  substr(list_filter(given, lambda x: starts_with(x, 'event='))[-1], 7) AS event, substr(list_filter(given, lambda x: starts_with(x, 'ts='))[-1], 4) AS ts FROM v),
g AS (SELECT *, CASE WHEN length(record) - length(replace(record, chr(10), '')) <> 1 THEN 'lines' WHEN ver IS DISTINCT FROM 'v1' THEN 'version'
  WHEN len(list_filter(given, lambda x: NOT regexp_matches(x, '^(gen|seq|state|source|event|ts)='))) > 0 THEN 'unknown-field'
  WHEN NOT regexp_matches(coalesce(gen, ''), '^[A-Za-z0-9._-]+$') THEN 'gen' WHEN NOT regexp_matches(coalesce(rs, ''), '^[0-9]+$') THEN 'seq'
  WHEN NOT coalesce(state, '') IN ('busy', 'idle', 'unknown') THEN 'state' WHEN NOT regexp_matches(coalesce(source, ''), '^[A-Za-z0-9._-]+$') THEN 'source'
  WHEN NOT regexp_matches(coalesce(event, ''), '^[A-Za-z0-9._-]+$') THEN 'event' WHEN NOT regexp_matches(coalesce(ts, ''), '^[0-9]+$') THEN 'ts' END AS fault FROM f)
SELECT task, seq, CASE WHEN fault IS NULL THEN gen END AS gen, CASE WHEN fault IS NULL THEN rs END AS record_seq, CASE WHEN fault IS NULL THEN state END AS state,
  CASE WHEN fault IS NULL THEN source END AS source, CASE WHEN fault IS NULL THEN event END AS event, CASE WHEN fault IS NULL THEN ts END AS ts, fault FROM g"""))
def busy_lines(spark: SparkSession, sf: str) -> DataFrame:
    body = view(spark, sf, "busy_records").select("task", "seq", F.expr(BUSY_BODY).alias("body"))
    return folds.read_busy(body.select("task", "seq", F.expr(BUSY_TEXT).alias("record")))


@query("dedupe_wakes", with_views("""
SELECT min(seq) AS first_seq, arg_max(epoch, seq) AS epoch, max(seq) AS seq, kind, arg_max(key, seq) AS key,
       arg_max(payload, seq) AS payload
FROM wakes GROUP BY kind, CASE WHEN kind = 'heartbeat' THEN 'heartbeat' ELSE key END"""))
def dedupe_wakes(spark: SparkSession, sf: str) -> DataFrame:
    return folds.dedupe_wakes(view(spark, sf, "wakes"))


@query("queued_keys", with_views("""
SELECT key, min(seq) AS first_seq FROM wakes WHERE kind = 'signal' GROUP BY key"""))
def queued_keys(spark: SparkSession, sf: str) -> DataFrame:
    return folds.queued_keys(view(spark, sf, "wakes"), "signal")


@query("merge_modes", with_views("""
SELECT regexp_extract(key, '^(.*)[.](status|turn-ended)$', 1) || '.status' AS status_key,
  CASE WHEN bool_or(ends_with(key, '.status')) THEN 'direct' ELSE 'historical' END AS mode, min(seq) AS first_seq
FROM wakes WHERE kind = 'signal' AND regexp_matches(key, '^[A-Za-z0-9_-][A-Za-z0-9._-]*[.](status|turn-ended)$')
GROUP BY 1"""))
def merge_modes(spark: SparkSession, sf: str) -> DataFrame:
    return folds.merge_modes(folds.annotation_modes(view(spark, sf, "wakes")))


@query("escalation_digest", with_views("""
SELECT task, CAST(floor((rn - 1) / 20.0) AS BIGINT) AS part, count(*) AS items, string_agg(note, ' | ' ORDER BY seq) AS digest
FROM (SELECT task, seq, note, row_number() OVER (PARTITION BY task ORDER BY seq) AS rn FROM status_events) GROUP BY 1, 2"""))
def escalation_digest(spark: SparkSession, sf: str) -> DataFrame:
    return folds.digest(view(spark, sf, "status_events"), ["task"], "seq", F.col("note"), part_items=20)


@query("key_union", with_views("""
SELECT task, key FROM status_events WHERE verb = 'captain-held'
UNION SELECT task, key FROM status_events WHERE verb = 'needs-decision'"""))
def key_union(spark: SparkSession, sf: str) -> DataFrame:
    logs = view(spark, sf, "status_events")
    return folds.key_union(logs.filter("verb = 'captain-held'"), logs.filter("verb = 'needs-decision'"))


_LANES = ", ".join(
    f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(8))


@query("set_signature", with_views(f"""
WITH m AS (SELECT DISTINCT task, key FROM status_events WHERE verb = 'blocked'),
h AS (SELECT task, sha256(key) AS h FROM m)
SELECT task, count(*) AS members, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_LANES})) AS signature
FROM h GROUP BY task"""))
def set_signature(spark: SparkSession, sf: str) -> DataFrame:
    blocked = view(spark, sf, "status_events").filter("verb = 'blocked'")
    return folds.set_signature(blocked, ["task"], "key")


@query("misplaced_hits", with_views("""
WITH s AS (SELECT DISTINCT concat('h', CAST(task % 25 AS VARCHAR)) AS home, task, seq, line,
    lower(regexp_extract(line, 'corr=([A-Fa-f0-9]{16})', 1)) AS corr FROM report_lines
  WHERE regexp_matches(line, 'corr=[A-Fa-f0-9]{16}') AND NOT contains(line, 'pending-reply-missed'))
SELECT r.corr, r.home, count(s.seq) AS hits FROM requests r LEFT JOIN s ON s.corr = r.corr AND s.home = r.home
WHERE r.phase <> 'resolved' AND r.delivered_epoch IS NOT NULL GROUP BY r.corr, r.home"""))
def misplaced_hits(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "report_lines").select(
        F.concat(F.lit("h"), (F.col("task") % 25).cast("string")).alias("home"),
        F.col("task").cast("string").alias("path"), F.col("seq").alias("line_no"), "line")
    return folds.misplaced_hits(lines, view(spark, sf, "requests"))


@query("family_rollup", with_views("""
SELECT family, count(*) AS scripts, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
       CAST(sum(CASE WHEN exit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM timings GROUP BY family"""))
def family_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.family_rollup(view(spark, sf, "timings"))


def lanes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "timings").groupBy("lane").agg(
        F.count("*").alias("total"), F.sum(F.col("exit").cast("long")).alias("failed"),
        F.sum(F.col("gate_skip").cast("long")).alias("skipped_gate"), F.sum("duration_ms").alias("duration_ms"))


@query("lane_totals", with_views("""
WITH l AS (SELECT lane, count(*) AS total, sum(exit) AS failed, sum(CAST(gate_skip AS INT)) AS sk, sum(duration_ms) AS d
  FROM timings GROUP BY lane)
SELECT count(*) AS lanes, CAST(sum(total) AS BIGINT) AS total, CAST(sum(failed) AS BIGINT) AS failed,
       CAST(sum(sk) AS BIGINT) AS skipped_gate, CAST(max(d) AS BIGINT) AS critical_path_ms FROM l"""))
def lane_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.lane_totals(lanes(spark, sf))


@query("slowest_scripts", with_views("""
SELECT path, family, duration_ms FROM timings ORDER BY duration_ms DESC, path LIMIT 15"""))
def slowest_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.slowest(view(spark, sf, "timings").select("path", "family", "duration_ms"))


@query("budget_report", """
WITH s AS (SELECT source, doc_id, CAST(ceil(strlen(text) / 3.0) AS BIGINT) AS tokens,
    CASE WHEN doc_id % 50 = 7 THEN 'shared' ELSE 'own' END AS file FROM documents)
SELECT source AS owner, CAST(sum(tokens) AS BIGINT) AS total_tokens,
  CASE WHEN sum(tokens) <= 20000 THEN 'within-budget' ELSE 'over-budget' END AS status,
  coalesce(max(CASE WHEN file = 'shared' THEN tokens END) > 20000, false) AS shared_exceeds
FROM s GROUP BY source""")
def budget_report(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("owner"),
        F.when(F.col("doc_id") % 50 == 7, "shared").otherwise("own").alias("file"), "text")
    return rollups.budget_report(docs, 20000, "shared")
