"""Streaming forms, run over the event table until everything available is processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import query
from tidelog.catalog.fold_queries import OPEN_SQL
from tidelog.catalog.source_queries import EVENTS_SQL, terminal_events
from tidelog.catalog.text_queries import deploy_line
from tidelog.catalog.views import table, view, view_over, with_views
from tidelog.functions import text as tx
from tidelog.operators import folds
from tidelog.sources import ledgers
from tidelog.streaming import jobs, mirror


def stream_view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view over the event table as a stream; at most 64 files per trigger. The pattern lets the
    table be one file or a folder of files."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/event[s].parquet")
    return view_over(spark, name, events=events)


def stream_table(spark: SparkSession, df: DataFrame, name: str, files: int = 64) -> DataFrame:
    """A derived table as a stream: written to the shared folder and read back, so many files a trigger."""
    path = jobs.shared_folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def finish(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    return jobs.run_to_table(stream, jobs.shared_folder(stream.sparkSession, name), mode)


def through(stream: DataFrame, name: str, make: Callable[[str], jobs.BatchFn]) -> str:
    path = jobs.shared_folder(stream.sparkSession, name)
    jobs.run_batches(stream, make(path), path)
    return path


@query("stream_open_decisions", with_views(OPEN_SQL))
def stream_open_decisions(spark: SparkSession, sf: str) -> DataFrame:
    path = jobs.shared_folder(spark, "open-decisions")
    lines = tx.parse_status(stream_view(spark, sf, "status_events").select("task", "seq", "line"))
    jobs.run_batches(jobs.stream_open_decisions(lines), jobs.apply_moves(f"{path}/open"), path, "update")
    return jobs.open_set(spark, f"{path}/open", lines.schema["task"].dataType.simpleString())


@query("folded_logs", with_views("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq) AS rn, count(*) OVER (PARTITION BY task) AS n FROM status_events),
e AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY seq) AS seq, verb, key, note FROM r
  WHERE task % 4 < 2 OR (task % 4 = 2 AND k % 2 = 0) OR (task % 4 = 3 AND rn <= n // 3)),
o AS (SELECT task, key, max(seq) AS seq, arg_max(verb, seq) AS verb, arg_max(note, seq) AS note FROM e
  WHERE verb IN ('needs-decision', 'blocked', 'resolved', 'captain-held')
    AND (NOT starts_with(key, 'pending-reply-') OR starts_with(note, 'pending-reply-missed:'))
  GROUP BY task, key)
SELECT task, key, seq, verb, note FROM o WHERE verb IN ('needs-decision', 'blocked')"""))
def folded_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs that grow, shrink and grow again, are replaced by another file, or can no longer be read, over three looks."""
    from tidelog.operators import ordered

    path = jobs.shared_folder(spark, "folded-logs")
    events = view(spark, sf, "status_events").select("task", "seq", "line", "k")
    first = ordered.rank(events, ["task"], "seq").withColumn("ident", F.lit("first"))
    second = ordered.rank(events.filter("task % 4 = 2 AND k % 2 = 0"), ["task"], "seq").withColumn("ident", F.lit("second"))
    files = first.unionByName(second).select("task", "ident", F.col("rn").alias("seq"), "line")
    tx.parse_status(files).select("task", "ident", "seq", "verb", "key", "note").write.parquet(f"{path}/files")
    logs = spark.read.parquet(f"{path}/files")
    sizes = logs.groupBy("task").agg(F.count(F.when(F.col("ident") == "first", 1)).alias("n"), F.count(F.when(F.col("ident") == "second", 1)).alias("m"))
    what = F.col("task") % 4
    for look in (1, 2, 3):
        ident = F.when((what == 3) & F.lit(look > 1), None).when((what == 2) & F.lit(look > 1), "second").otherwise("first")
        size = (F.when((what == 2) & F.lit(look > 1), F.col("m")).when((what == 1) & F.lit(look == 2), F.expr("n div 6"))
                .otherwise(F.expr(f"n * {look} div 3")))
        sizes.select("task", F.lit(look).alias("look"), ident.alias("ident"), size.alias("size")).coalesce(1).write.mode("append").parquet(f"{path}/looks")
    seen = spark.readStream.schema(spark.read.parquet(f"{path}/looks").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/looks")

    def read(plan: DataFrame) -> DataFrame:
        return logs.join(plan, ["task", "ident"]).filter("seq > past AND seq <= size")

    jobs.run_batches(seen, jobs.fold_logs(read, f"{path}/fold"), path)
    return jobs.folded_set(spark, f"{path}/fold", logs.schema["task"].dataType.simpleString())


@query("drain_wakes", with_views("""
SELECT min(seq) AS first_seq, arg_max(epoch, seq) AS epoch, max(seq) AS seq, kind, arg_max(key, seq) AS key,
       arg_max(payload, seq) AS payload
FROM wakes GROUP BY kind, CASE WHEN kind = 'heartbeat' THEN 'heartbeat' ELSE key END"""))
def drain_wakes(spark: SparkSession, sf: str) -> DataFrame:
    path = through(stream_view(spark, sf, "wakes"), "drain", lambda p: jobs.drain_wakes(f"{p}/drained"))
    cols = ["epoch", "seq", "kind", "key", "payload"]
    merge = F.when(F.col("kind") == "heartbeat", "heartbeat").otherwise(F.col("key")).alias("merge")
    top = F.max_by(F.struct(*cols), F.col("seq")).alias("top")
    # Batches are drained one by one; merged again they equal one drain of everything.
    return spark.read.parquet(f"{path}/drained").groupBy(F.col("kind").alias("of"), merge).agg(
        F.min("first_seq").alias("first_seq"), top).select("first_seq", *[f"top.{c}" for c in cols])


# A window opens at the first change after the one before it has closed, and is said once the stream has passed its end.
@query("coalesce_signals", with_views("""
WITH RECURSIVE w AS (SELECT task AS home, min(ts) AS opened FROM status_events GROUP BY task
  UNION ALL SELECT home, opened FROM (SELECT w.home, min(e.ts) AS opened FROM w JOIN status_events e ON e.task = w.home AND e.ts >= w.opened + 36000
    GROUP BY w.home, w.opened))
SELECT w.home, 'signal' AS kind, w.opened + 36000 AS ts, max(e.seq) AS seq, e.key AS name, arg_max(e.note, e.seq) AS content
FROM w JOIN status_events e ON e.task = w.home AND e.ts >= w.opened AND e.ts < w.opened + 36000
WHERE w.opened + 36000 < (SELECT max(ts) FROM status_events) GROUP BY w.home, w.opened, e.key"""))
def coalesce_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = stream_view(spark, sf, "status_events").select(
        F.col("task").alias("home"), "ts", "seq", F.col("key").alias("name"), F.col("note").alias("content"))
    return finish(jobs.coalesce_signals(rows, grace=36000), "signals")


@query("batch_escalations")
def batch_escalations(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("k") == 7, "down").when(F.col("k") == 8, "up").otherwise("item")
    rows = stream_view(spark, sf, "status_events").select(
        (F.col("task") % 20).alias("channel"), "ts", "seq", kind.alias("kind"), F.col("note").alias("item"))
    return finish(jobs.batch_escalations(rows, batch=9000, max_defer=30000), "escalations")


def timer_rows(base: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Polls, checks and log lines of an entity in one row shape."""
    k = F.col("k")
    kind = F.when(F.col("event_type") == "view", "log").when(k % 4 == 0, "check").otherwise("poll")
    return base.select(
        (F.col("task") % 20).alias("entity"), "ts", "seq", kind.alias("kind"),
        (F.floor(F.col("seq") / 400) % 3).cast("long").alias("hash"), (k % 37 == 0).alias("busy"),
        F.when(k % 13 == 0, "parked").when(k % 5 == 0, "done").otherwise("working").alias("phase"),
        F.concat(F.lit("t"), (F.floor(F.col("seq") / 700) % 3).cast("string")).alias("token"),
        F.when(k % 17 == 0, "dead").otherwise("alive").alias("agent"),
        F.when(k % 2 == 0, "paused").otherwise("working").alias("verb"))


@query("stream_timers")
def stream_timers(spark: SparkSession, sf: str) -> DataFrame:
    return finish(jobs.stream_timers(timer_rows(stream_view(spark, sf, "status_events"))), "timers")


def alert_rows(base: DataFrame) -> DataFrame:
    blank = (F.col("event_type") != "error") & (F.col("k") % 7 == 2)
    line = F.when(blank, "").otherwise(deploy_line())
    to = (F.when(F.col("event_type") == "signup", "working").when(F.col("event_type") == "error", "blocked")
          .otherwise("idle"))
    return base.select(
        F.col("task").alias("entity"), "ts", "seq", (F.col("value") >= 40).alias("over"), tx.line_failed(line).alias("failed"),
        F.regexp_replace(line, r"^\d{4}-\d{2}-\d{2}T[0-9:.,+-]*\s*", "").alias("text"), to.alias("to_status"))


@query("stream_rising_edges", with_views("""
SELECT task AS entity, seq FROM (SELECT task, seq, value >= 40 AS over_it,
  lag(value >= 40) OVER (PARTITION BY task ORDER BY seq) AS was FROM status_events) WHERE over_it AND NOT coalesce(was, false)"""))
def stream_rising_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = alert_rows(stream_view(spark, sf, "status_events"))
    return finish(jobs.stream_alert_edges(rows, "rising"), "rising").select("entity", "seq")


@query("stream_alert_texts", with_views("""
WITH d AS (SELECT task, seq, CASE WHEN event_type = 'error' THEN concat('Z FAILED: code ', CAST(k % 4 AS STRING))
    WHEN k % 7 = 0 THEN concat('ALERT raised ', note) WHEN k % 7 = 1 THEN 'ALERTS are off' WHEN k % 7 = 2 THEN '' ELSE concat('ok ', note) END AS txt FROM status_events),
x AS (SELECT *, regexp_matches(txt, 'FAILED:|(^|[ ])ALERT([ ]|$)') AS bad FROM d WHERE txt <> ''),
p AS (SELECT *, lag(bad) OVER w AS was_bad, lag(txt) OVER w AS was_txt FROM x WINDOW w AS (PARTITION BY task ORDER BY seq))
SELECT task AS entity, seq, txt AS text FROM p WHERE bad AND NOT (coalesce(was_bad, false) AND was_txt = txt)"""))
def stream_alert_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = alert_rows(stream_view(spark, sf, "status_events"))
    return finish(jobs.stream_alert_edges(rows, "text"), "texts").select("entity", "seq", "text")


@query("stream_fresh_edges", with_views("""
SELECT entity, seq FROM (SELECT entity, seq, to_status, lag(to_status) OVER (PARTITION BY entity ORDER BY seq) AS was
  FROM transitions WHERE to_status IN ('blocked', 'working')) WHERE to_status = 'blocked' AND coalesce(was, 'working') = 'working'"""))
def stream_fresh_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = alert_rows(stream_view(spark, sf, "status_events"))
    return finish(jobs.stream_alert_edges(rows, "edge"), "edges").select("entity", "seq")


@query("stream_busy_state", with_views("""
WITH r AS (SELECT task, seq, event_type = 'signup' AS arm, seq - CASE WHEN k % 4 = 0 THEN 900 ELSE 0 END AS gen_seq,
    CASE WHEN event_type = 'signup' THEN CAST(seq AS VARCHAR) END AS armed_gen, k FROM status_base),
g AS (SELECT *, coalesce(last_value(armed_gen IGNORE NULLS) OVER w, '') AS current_gen,
    count(*) FILTER (WHERE arm) OVER w AS life FROM r WINDOW w AS (PARTITION BY task ORDER BY seq)),
e AS (SELECT *, life > 0 AND k % 5 <> 0 AS gen_ok FROM g WHERE NOT arm),
m AS (SELECT *, max(CASE WHEN gen_ok THEN gen_seq END) OVER (PARTITION BY task, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT task, seq, CASE WHEN gen_ok AND gen_seq > greatest(coalesce(top, -1), -1) THEN 'accepted' ELSE 'stale' END AS kind FROM m
UNION ALL SELECT task, seq, 'armed' FROM r WHERE arm"""))
def stream_busy_state(spark: SparkSession, sf: str) -> DataFrame:
    from tidelog.operators import ordered

    base = view(spark, sf, "status_base").select("task", "seq", "ts", "k", "event_type")
    arm = F.col("event_type") == "signup"
    marked = base.withColumn("__own", F.when(arm, F.col("seq").cast("string")))
    known = ordered.scan(marked, ["task"], "seq", last={"__gen": F.col("__own")})
    gen = F.when(arm, F.col("__own")).when(F.col("k") % 5 == 0, "other").otherwise(F.coalesce("__gen", F.lit("none")))
    rows = known.select(
        "task", "ts", "seq", F.when(arm, "arm").otherwise("event").alias("kind"), gen.alias("gen"),
        (F.col("seq") - F.when(F.col("k") % 4 == 0, 900).otherwise(0)).alias("gen_seq"),
        F.when(F.col("k") % 2 == 0, "busy").otherwise("idle").alias("state"))
    out = finish(jobs.stream_busy_state(stream_table(spark, rows, "busy-rows")), "busy")
    return out.select("task", "seq", "kind")


def reply_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with the activity, recovery outcomes and reports that follow them, per token."""
    base = view(spark, sf, "status_base")
    asked = F.when(F.col("event_type") == "signup", F.col("seq")).otherwise(F.col("seq") - 1 - F.col("k") % 20)
    kind = (F.when(F.col("event_type") == "signup", "request").when(F.col("event_type") == "view", "idle")
            .when(F.col("event_type") == "click", "busy").when(F.col("event_type") == "error", "outcome").otherwise("report"))
    text = (F.when(F.col("event_type") == "error", F.when(F.col("k") % 3 == 0, "confirmed").when(F.col("k") % 3 == 1, "failed")
                   .otherwise("unknown")).when(F.col("event_type") == "purchase", "status"))
    return base.select(
        F.substring(F.md5(asked.cast("string")), 1, 16).alias("corr"), "ts", "seq", kind.alias("kind"), text.alias("text"))


@query("stream_replies")
def stream_replies(spark: SparkSession, sf: str) -> DataFrame:
    rows = reply_rows(spark, sf)
    return finish(jobs.stream_replies(stream_table(spark, rows, "reply-rows"), grace=120), "replies")


OFFER_TTL = 4 * 86400


@query("offer_once", with_views(f"""
WITH RECURSIVE r AS (SELECT concat('r', CAST(k AS VARCHAR), '-', CAST(task % 5 AS VARCHAR)) AS request, ts FROM status_base),
o AS (SELECT request, min(ts) AS ts FROM r GROUP BY request
  UNION ALL SELECT request, ts FROM (SELECT o.request, min(r.ts) AS ts FROM o JOIN r ON r.request = o.request AND r.ts >= o.ts + {OFFER_TTL} GROUP BY o.request, o.ts))
SELECT request, ts FROM o"""))
def offer_once(spark: SparkSession, sf: str) -> DataFrame:
    request = F.concat(F.lit("r"), F.col("k").cast("string"), F.lit("-"), (F.col("task") % 5).cast("string"))
    rows = stream_view(spark, sf, "status_base").select(request.alias("request"), "ts", "seq")
    return finish(jobs.offer_once(rows, OFFER_TTL), "offers").filter("kind = 'offer'").select("request", "ts")


@query("consume_events", f"""
WITH {EVENTS_SQL} SELECT n, event_id, coalesce(reason, 'accepted') AS outcome FROM f
UNION ALL SELECT n, event_id, reason FROM f WHERE reason IS NOT NULL AND n % 3 = 0""")
def consume_events(spark: SparkSession, sf: str) -> DataFrame:
    events = terminal_events(spark, sf)
    twice = events.unionByName(events.filter("n % 3 = 0"))
    path = through(stream_table(spark, twice, "terminal-events"), "consumed",
                   lambda p: jobs.consume_events(ledgers.event_rules(), f"{p}/out"))
    accepted = spark.read.parquet(f"{path}/out/accepted").select("n", "event_id", F.lit("accepted").alias("outcome"))
    return accepted.unionByName(
        spark.read.parquet(f"{path}/out/rejected").select("n", "event_id", F.col("reason").alias("outcome")))


@query("reannounce", with_views("""
SELECT task AS source, seq, concat(CAST(task AS VARCHAR), '.', CAST(seq AS VARCHAR), '.result') AS path
FROM status_events WHERE event_type = 'click' AND k % 3 <> 0"""))
def reannounce(spark: SparkSession, sf: str) -> DataFrame:
    from tidelog.catalog.join_queries import result_tables

    results, handled = result_tables(spark, sf)
    rows = results.withColumn("kind", F.lit("result")).unionByName(handled.withColumn("kind", F.lit("handled")), allowMissingColumns=True)
    shuffled = rows.repartition(6, F.xxhash64("seq", "kind"))
    path = through(stream_table(spark, shuffled, "result-rows", files=2), "announced", lambda p: jobs.reannounce(f"{p}/out"))
    out = spark.read.parquet(f"{path}/out/announced")
    newest = out.agg(F.max("batch_id").alias("batch_id"))
    return out.join(newest, "batch_id").select("source", "seq", "path")


@query("mirror_log", with_views("""
WITH r AS (SELECT task AS log, line, row_number() OVER w AS rn, sum(strlen(line) + 1) OVER w AS until FROM status_events
  WINDOW w AS (PARTITION BY task ORDER BY seq)),
s AS (SELECT log, max(until) AS total FROM r GROUP BY log)
SELECT log, min(rn) AS seq, line FROM r JOIN s USING (log) WHERE log % 5 <> 0 OR total <= 600 OR until <= 600 GROUP BY log, line
UNION ALL SELECT log, NULL, concat('blocked [key=mirror-continuity-', CAST(log AS VARCHAR), ']: mirror continuity broke (prefix-changed)')
FROM s WHERE log % 5 = 0 AND total > 600"""))
def mirror_log(spark: SparkSession, sf: str) -> DataFrame:
    """Logs in pieces of 200 bytes, over files and triggers in no order; every fifth log is another one from byte 600 on."""
    from tidelog.operators import ordered

    lines = ordered.rank(view(spark, sf, "status_events").select(F.col("task").alias("log"), "seq", "line"), ["log"], "seq")
    pieces = mirror.cut_pieces(lines.select("log", F.col("rn").alias("seq"), "line"), 200)
    other = (F.col("log") % 5 == 0) & (F.col("at") >= 600)
    pieces = pieces.withColumn("prefix", F.when(other, F.concat(F.lit("x"), "prefix")).otherwise(F.col("prefix")))
    shuffled = pieces.repartition(9, F.xxhash64("log", "at"))
    with mirror.keyed_store(spark):
        return finish(mirror.mirror_log(stream_table(spark, shuffled, "pieces", files=3), 4096), "mirror")


@query("catch_all_sweep", with_views("""
WITH c AS (SELECT task, arg_max(line, seq) AS line, arg_max(verb, seq) AS verb, max(seq) AS seq FROM status_events GROUP BY task),
s AS (SELECT task, arg_max(line, seq) AS line FROM status_events WHERE k % 4 <> 0 GROUP BY task)
SELECT c.task, c.seq, c.line FROM c LEFT JOIN s ON s.task = c.task
WHERE c.verb IN ('done', 'needs-decision', 'blocked', 'failed') AND c.line IS DISTINCT FROM s.line"""))
def catch_all_sweep(spark: SparkSession, sf: str) -> DataFrame:
    logs = view(spark, sf, "status_events")
    surfaced = folds.latest_event(logs.filter("k % 4 <> 0"), ["line"])
    return jobs.catch_all_sweep(logs, surfaced).select("task", "seq", "line")


@query("timed_sweep", with_views("""
WITH h AS (SELECT max(seq) // 2 AS half FROM status_events),
a AS (SELECT task, max(seq) AS seq, arg_max(verb, seq) AS verb, arg_max(line, seq) AS line FROM status_events, h WHERE seq <= half GROUP BY task),
b AS (SELECT task, max(seq) AS seq, arg_max(verb, seq) AS verb, arg_max(line, seq) AS line FROM status_events GROUP BY task),
s AS (SELECT task, seq, line FROM a WHERE verb IN ('done', 'needs-decision', 'blocked', 'failed'))
SELECT 1000 AS at, task, seq, line FROM s
UNION ALL SELECT 1300, b.task, b.seq, b.line FROM b LEFT JOIN s ON s.task = b.task
WHERE b.verb IN ('done', 'needs-decision', 'blocked', 'failed') AND b.line IS DISTINCT FROM s.line"""))
def timed_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Four ticks: a sweep of the first half of the logs, one that comes too early, one of all, and one with nothing new."""
    logs = view(spark, sf, "status_events")
    half = logs.agg(F.floor(F.max("seq") / 2).alias("half"))

    def read(spark: SparkSession, now: int) -> DataFrame:
        return logs.join(F.broadcast(half), F.col("seq") <= F.col("half")).drop("half") if now < 1300 else logs

    path = jobs.shared_folder(spark, "sweep")
    for now in (1000, 1299, 1300, 1700):
        spark.range(1).select(F.lit(now).cast("long").alias("now")).coalesce(1).write.mode("append").parquet(f"{path}/ticks")
    ticks = spark.readStream.schema("now long").option("maxFilesPerTrigger", 1).parquet(f"{path}/ticks")
    jobs.run_batches(ticks, jobs.timed_sweep(read, f"{path}/out"), path)
    return spark.read.parquet(f"{path}/out/surfaced").select("at", "task", "seq", "line")
