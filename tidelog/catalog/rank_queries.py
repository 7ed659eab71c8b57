"""Rankings, caps, budgets, tails and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import query
from tidelog.catalog.views import table, view, with_views
from tidelog.operators import ordered, ranking

LANDED = "landed AS (SELECT home, id, title, date FROM backlog_base WHERE state = 'done' AND structured AND kind <> 'captain')"


def landed(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "backlog_base").filter(
        "state = 'done' AND structured AND kind <> 'captain'").select("home", "id", "title", "date")


@query("landed_per_home", with_views(f"""
WITH {LANDED} SELECT home, id, date, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY home ORDER BY coalesce(date, '') DESC, id DESC) AS rn FROM landed) WHERE rn <= 6"""))
def landed_per_home(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.landed_per_home(landed(spark, sf), 6).select(
        "home", "id", "date", F.col("rn").cast("long").alias("rn"))


@query("round_robin", with_views(f"""
WITH {LANDED}, r AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY coalesce(date, '') DESC, id DESC) AS rn FROM landed)
SELECT home, id FROM r WHERE rn <= 3 ORDER BY rn, home LIMIT 60"""))
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.round_robin(landed(spark, sf), 60, 3).select("home", "id")


@query("landed_all", with_views(f"WITH {LANDED} SELECT home, id, date FROM landed"))
def landed_all(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.landed_all(landed(spark, sf)).select("home", "id", "date")


@query("cap_section", with_views("""
SELECT CAST(id AS VARCHAR) AS subject FROM (SELECT id FROM task_rows WHERE state = 'working' ORDER BY seq LIMIT 20)
UNION ALL SELECT concat('in_flight showing 20 of ', CAST(count(*) AS VARCHAR)) FROM task_rows WHERE state = 'working' HAVING count(*) > 20"""))
def cap_section(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "task_rows").filter("state = 'working'")
    shown, omitted = ranking.cap_section(rows, "in_flight", ["seq"], 20, "--all-in_flight")
    return shown.select(F.col("id").cast("string").alias("subject")).unionByName(
        omitted.select(F.col("surface").alias("subject")))


@query("ready_listing", with_views("""
WITH q AS (SELECT id, seq, hold_reason IS NOT NULL AS gated FROM backlog_rows WHERE state = 'queued')
SELECT id, seq, gated FROM q WHERE gated
UNION ALL (SELECT id, seq, gated FROM q WHERE NOT gated ORDER BY seq LIMIT 25)"""))
def ready_listing(spark: SparkSession, sf: str) -> DataFrame:
    queued = view(spark, sf, "backlog_rows").filter("state = 'queued'").select("id", "seq", "hold_reason")
    shown, _ = ranking.ready_listing(queued, F.col("hold_reason").isNotNull(), ["seq"], 25)
    return shown.select("id", "seq", "gated")


@query("ready_listing_counts", with_views("""
WITH q AS (SELECT hold_reason IS NOT NULL AS gated FROM backlog_rows WHERE state = 'queued')
SELECT count(*) FILTER (WHERE gated) AS gated_rows, least(count(*) FILTER (WHERE NOT gated), 25) AS plain_shown,
       count(*) FILTER (WHERE NOT gated) AS plain_total FROM q"""))
def ready_listing_counts(spark: SparkSession, sf: str) -> DataFrame:
    queued = view(spark, sf, "backlog_rows").filter("state = 'queued'").select("id", "seq", "hold_reason")
    return ranking.ready_listing(queued, F.col("hold_reason").isNotNull(), ["seq"], 25)[1]


@query("fit_budget", with_views("""
WITH RECURSIVE items AS (SELECT task, seq, length(note) + 1 + k AS size,
    row_number() OVER (PARTITION BY task ORDER BY seq) AS i FROM status_events),
walk AS (SELECT task, 0 AS i, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS seq, false AS taken FROM (SELECT DISTINCT task FROM items)
  UNION ALL SELECT w.task, w.i + 1, CASE WHEN w.used + n.size <= 900 THEN w.used + n.size ELSE w.used END, n.seq, w.used + n.size <= 900
  FROM walk w JOIN items n ON n.task = w.task AND n.i = w.i + 1)
SELECT task, seq FROM walk WHERE taken"""))
def fit_budget(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "status_events").select(
        "task", "seq", (F.length("note") + 1 + F.col("k")).alias("size"))
    return ranking.fit_budget(items, ["task"], "seq", "size", 1000, reserve=100).select("task", "seq")


@query("budget_omissions", with_views("""
WITH RECURSIVE items AS (SELECT task, seq, length(note) + 1 + k AS size,
    row_number() OVER (PARTITION BY task ORDER BY seq) AS i FROM status_events),
walk AS (SELECT task, 0 AS i, CAST(0 AS BIGINT) AS used, false AS taken FROM (SELECT DISTINCT task FROM items)
  UNION ALL SELECT w.task, w.i + 1, CASE WHEN w.used + n.size <= 400 THEN w.used + n.size ELSE w.used END, w.used + n.size <= 400
  FROM walk w JOIN items n ON n.task = w.task AND n.i = w.i + 1)
SELECT task, count(*) FILTER (WHERE taken) AS shown, count(*) FILTER (WHERE NOT taken) AS omitted FROM walk WHERE i > 0 GROUP BY task"""))
def budget_omissions(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "status_events").select("task", "seq", (F.length("note") + 1 + F.col("k")).alias("size"))
    return ranking.omitted(items, ranking.fit_budget(items, ["task"], "seq", "size", 400), ["task"])


@query("bounded_tail", with_views("""
WITH t AS (SELECT task, seq, line, strlen(line) + 1 AS size FROM status_events),
r AS (SELECT *, row_number() OVER w AS rn, sum(size) OVER w AS from_end, sum(size) OVER (PARTITION BY task) AS bytes
  FROM t WINDOW w AS (PARTITION BY task ORDER BY seq DESC))
SELECT task, seq, line FROM r WHERE rn <= 24 AND (bytes <= 800 OR from_end < 800)"""))
def bounded_tail(spark: SparkSession, sf: str) -> DataFrame:
    logs = view(spark, sf, "status_events").select("task", "seq", "line")
    return ranking.bounded_tail(logs, ["task"], "seq", "line", 24, 800)[0]


@query("bounded_tail_reasons", """
WITH t AS (SELECT conv_id, turn, strlen(text) + 1 AS size FROM conversations),
r AS (SELECT *, row_number() OVER w AS rn, sum(size) OVER w AS from_end, sum(size) OVER (PARTITION BY conv_id) AS bytes
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, count(*) AS lines, CAST(max(bytes) AS BIGINT) AS bytes, max(bytes) > 3000 AS byte_limit,
  count(*) FILTER (WHERE bytes <= 3000 OR from_end < 3000) > 4 AS line_limit FROM r GROUP BY conv_id""")
def bounded_tail_reasons(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return ranking.bounded_tail(turns, ["conv_id"], "turn", "text", 4, 3000)[1]


@query("lpt_assign", with_views("""
WITH RECURSIVE items AS (SELECT lane, path, CASE WHEN duration_ms % 23 = 0 THEN 15000 ELSE duration_ms END AS w FROM timings),
o AS (SELECT lane, path, w, row_number() OVER (PARTITION BY lane ORDER BY w DESC, path) AS i FROM items),
walk AS (SELECT lane, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS l1, CAST(0 AS BIGINT) AS l2, CAST(0 AS BIGINT) AS l3,
    CAST(0 AS BIGINT) AS bin, '' AS path, CAST(0 AS BIGINT) AS w FROM (SELECT DISTINCT lane FROM o)
  UNION ALL SELECT z.lane, z.i, CASE WHEN z.b = 1 THEN l1 + z.w ELSE l1 END, CASE WHEN z.b = 2 THEN l2 + z.w ELSE l2 END,
    CASE WHEN z.b = 3 THEN l3 + z.w ELSE l3 END, z.b, z.path, z.w
  FROM (SELECT k.lane, k.i + 1 AS i, l1, l2, l3, n.path, n.w, CAST(CASE WHEN l1 <= l2 AND l1 <= l3 THEN 1 WHEN l2 <= l3 THEN 2 ELSE 3 END AS BIGINT) AS b
        FROM walk k JOIN o n ON n.lane = k.lane AND n.i = k.i + 1) z)
SELECT lane, path, w AS weight, bin FROM walk WHERE i > 0"""))
def lpt_assign(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.when(F.col("duration_ms") % 23 != 0, F.col("duration_ms"))
    scripts = view(spark, sf, "timings").select("lane", "path", weight.alias("weight"))
    return ranking.lpt_assign(scripts, ["lane"], "path", "weight", 3, 15000)


@query("quota_choice", """
WITH req AS (SELECT l_orderkey AS request, l_linenumber AS idx, l_suppkey AS vendor FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
q AS (SELECT s_suppkey AS vendor, CASE WHEN s_suppkey % 3 = 0 THEN 'stale' ELSE 'fresh' END AS status, w AS window_id,
    CASE WHEN s_suppkey % 8 = 5 THEN 'model' ELSE 'session' END AS kind,
    CASE WHEN s_suppkey % 10 <> 9 THEN CAST((s_suppkey * 37 + n_nationkey * 11 + w * 13) % 100 AS BIGINT) END AS remaining
  FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest([1, 2, 3]) AS w)),
s AS (SELECT vendor, min(remaining) AS score, max(CASE WHEN status = 'fresh' THEN 1 ELSE 0 END) AS fresh FROM q
  WHERE window_id <= 2 AND kind <> 'model' AND remaining IS NOT NULL GROUP BY vendor),
c AS (SELECT r.request, r.idx, r.vendor, score, fresh FROM req r LEFT JOIN s ON s.vendor = r.vendor),
f AS (SELECT request, idx, score FROM c WHERE fresh = 1 QUALIFY row_number() OVER (PARTITION BY request ORDER BY score DESC, idx) = 1),
t AS (SELECT request, idx, score FROM c WHERE fresh = 0 QUALIFY row_number() OVER (PARTITION BY request ORDER BY score DESC, idx) = 1),
o AS (SELECT r.request, min(r.idx) AS first_idx FROM req r GROUP BY r.request),
p AS (SELECT o.request, CASE WHEN t.idx IS NOT NULL AND (f.idx IS NULL OR t.score >= f.score + 20) THEN t.idx ELSE f.idx END AS pick, first_idx
  FROM o LEFT JOIN f ON f.request = o.request LEFT JOIN t ON t.request = o.request)
SELECT p.request, coalesce(pick, first_idx) AS idx, r.vendor, pick IS NULL AS fallback
FROM p JOIN req r ON r.request = p.request AND r.idx = coalesce(pick, first_idx)""")
def quota_choice(spark: SparkSession, sf: str) -> DataFrame:
    first = F.min(F.struct("l_partkey", "l_suppkey"))["l_suppkey"]
    requests = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("idx")).agg(first.alias("vendor"))
    key = F.col("s_suppkey")
    windows = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("window_id")
    quota = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(key.alias("vendor"), F.when(key % 3 == 0, "stale").otherwise("fresh").alias("status"), windows,
             F.when(key % 8 == 5, "model").otherwise("session").alias("kind"), "n_nationkey")
    share = (F.col("vendor") * 37 + F.col("n_nationkey") * 11 + F.col("window_id") * 13) % 100
    quota = quota.withColumn("remaining", F.when(F.col("vendor") % 10 != 9, share.cast("long")))
    general = quota.filter("window_id <= 2").select("vendor", "window_id")
    return ranking.quota_choice(requests, quota, general)


@query("number_lines", with_views("""
SELECT task, seq, row_number() OVER (PARTITION BY task ORDER BY seq) AS rn,
       CAST(sum(k) OVER (PARTITION BY task ORDER BY seq) AS BIGINT) AS k_total FROM status_events"""))
def number_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "status_events").select("task", "seq", "k")
    one = {"rn": F.lit(1).cast("long"), "k_total": F.col("k").cast("long")}
    return ordered.scan(rows, ["task"], "seq", total=one).select("task", "seq", "rn", "k_total")
