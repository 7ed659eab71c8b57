"""Views that give the driver's tables the shapes the operators expect.

Each view is one SQL text that Spark and DuckDB read alike: integer arithmetic, no escapes inside
literals, explicit positions. ``@EPOCH(x)@`` is whole seconds since 1970 in either dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

# status_events: the log lines of one task per user.
VIEWS["status_base"] = """
SELECT user_id AS task, event_id AS seq, @EPOCH(ts)@ AS ts, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
FROM events"""
VIEWS["status_words"] = """
SELECT task, seq, ts, k, event_type, value,
       CASE WHEN event_type = 'click' THEN 'needs-decision'
            WHEN event_type = 'error' THEN 'blocked'
            WHEN event_type = 'purchase' AND k % 5 = 0 THEN 'captain-held'
            WHEN event_type = 'purchase' THEN 'resolved'
            WHEN event_type = 'signup' AND k % 7 = 0 THEN 'done'
            WHEN event_type = 'signup' THEN 'working'
            ELSE 'paused' END AS verb,
       CASE WHEN k % 10 = 0 THEN 'default'
            WHEN k % 10 = 1 THEN 'pending-reply-x'
            ELSE concat('k', CAST(k % 4 AS STRING)) END AS key,
       CASE WHEN k % 20 = 1 THEN 'pending-reply-missed: x'
            ELSE concat(event_type, ' ', CAST(seq AS STRING)) END AS note
FROM status_base"""
VIEWS["status_events"] = """
SELECT task, seq, ts, k, verb, key, note, event_type, value,
       CASE WHEN key = 'default' THEN concat(verb, ': ', note)
            ELSE concat(verb, ' [key=', key, ']: ', note) END AS line
FROM status_words"""

VIEWS["stamped_lines"] = """
SELECT task, seq, k,
       CASE WHEN k % 9 = 0 THEN concat('2024-01-02T03:04:05Z ', line)
            WHEN k % 9 = 1 THEN concat('[2024-01-02 03:04] ', line)
            WHEN k % 9 = 2 THEN concat('2024-01-02 ', line)
            WHEN k % 9 = 3 THEN concat('[2024-01-02T03:04:05.678+02:00] ', line)
            WHEN k % 9 = 4 THEN concat('2024-01-02T03:04:05', line)
            WHEN k % 9 = 5 THEN concat('[2024-01-02 ', line)
            WHEN k % 9 = 6 THEN concat('  2024-01-02T03:04:05-0130   ', line)
            WHEN k % 9 = 7 THEN concat('2024-1-2 ', line)
            ELSE line END AS line
FROM status_events"""
VIEWS["wakes"] = """
SELECT ts AS epoch, seq,
       CASE WHEN event_type = 'click' THEN 'signal' WHEN event_type = 'error' THEN 'stale'
            WHEN event_type = 'purchase' THEN 'check' ELSE 'heartbeat' END AS kind,
       CASE WHEN k % 3 = 0 THEN concat('u', CAST(task % 40 AS STRING), '.turn-ended')
            ELSE concat('u', CAST(task % 40 AS STRING), '.status') END AS key,
       concat(event_type, ' ', CAST(k AS STRING)) AS payload
FROM status_base"""
VIEWS["transitions"] = """
SELECT task AS entity, seq, ts,
       CASE WHEN event_type = 'signup' THEN 'working' WHEN event_type = 'error' THEN 'blocked'
            WHEN event_type = 'view' THEN 'idle' WHEN event_type = 'purchase' THEN 'done'
            ELSE 'unknown' END AS to_status
FROM status_base"""
VIEWS["polls"] = """
SELECT task % 20 AS entity, seq, ts,
       CAST(floor(seq / 400.0) AS BIGINT) % 3 AS hash, k % 37 = 0 AS busy,
       CASE WHEN k % 11 = 0 THEN 'idle' WHEN k % 3 = 0 THEN 'unknown' ELSE 'busy' END AS state
FROM status_base"""
VIEWS["checks"] = """
SELECT task % 20 AS entity, seq, ts,
       CASE WHEN k % 13 = 0 THEN 'parked' WHEN k % 5 = 0 THEN 'done' ELSE 'working' END AS phase,
       concat('t', CAST(CAST(floor(seq / 700.0) AS BIGINT) % 3 AS STRING)) AS token,
       CASE WHEN k % 17 = 0 THEN 'dead' ELSE 'alive' END AS agent
FROM status_base"""
VIEWS["busy_records"] = """
SELECT task, seq, concat('g', CAST(CAST(floor(seq / 1000.0) AS BIGINT) AS STRING)) AS gen,
       CASE WHEN seq % 13 = 0 THEN 'NaN' ELSE CAST(seq AS STRING) END AS record_seq,
       CASE WHEN k % 29 = 0 THEN 'walking' WHEN k % 2 = 0 THEN 'busy' ELSE 'idle' END AS state,
       CASE WHEN k % 7 = 0 THEN 'other-hook' ELSE 'main-hook' END AS source,
       event_type AS event, CAST(ts AS STRING) AS ts
FROM status_base"""
VIEWS["run_steps"] = """
SELECT task, seq, concat('r', CAST(k % 6 AS STRING)) AS run_id,
       CASE WHEN event_type = 'signup' THEN 'started' WHEN event_type = 'view' THEN 'note'
            ELSE 'terminal' END AS event
FROM status_base"""

# ledgers: requests, answers and posts.
VIEWS["requests"] = """
SELECT task, seq, ts, substr(md5(CAST(seq AS STRING)), 1, 16) AS corr,
       CASE WHEN k % 9 = 0 THEN 'resolved' ELSE 'awaiting_report' END AS phase,
       CASE WHEN k % 8 = 0 THEN NULL ELSE ts END AS delivered_epoch,
       concat('h', CAST(task % 25 AS STRING)) AS home
FROM status_base WHERE event_type = 'signup'"""
VIEWS["report_lines"] = """
SELECT task, seq,
       CASE WHEN k % 2 = 0 THEN concat(
              CASE WHEN k % 3 = 0 THEN 'done: see report.md '
                   WHEN k % 5 = 0 THEN 'done: via-helper ' ELSE 'done: answered ' END,
              'corr=', upper(substr(md5(CAST(seq - 1 - k % 20 AS STRING)), 1, 16)))
            WHEN k % 11 = 0 THEN concat('blocked: pending-reply-missed corr=',
              substr(md5(CAST(seq - 1 - k % 20 AS STRING)), 1, 16))
            ELSE 'working: no token' END AS line
FROM status_base"""

# backlog: one row per order, one home per nation.
VIEWS["backlog_base"] = """
SELECT o.o_orderkey AS id, o.o_orderkey AS seq, c.c_nationkey AS home,
       CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'in_flight'
            ELSE 'done' END AS state,
       o_orderkey % 97 <> 5 AS structured,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'captain'
            WHEN o_orderpriority = '2-HIGH' THEN 'program' ELSE 'ship' END AS kind,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS date,
       CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'captain' ELSE 'external' END
            END AS hold_kind,
       CASE WHEN o_orderkey % 11 = 0 THEN concat('waits for ', CAST(o_custkey AS STRING)) END AS hold_reason,
       CASE WHEN o_orderkey % 19 = 0 THEN 'this row is Superseded by a later one'
            ELSE concat('body of ', CAST(o_orderkey AS STRING)) END AS body_excerpt,
       concat('Order ', CAST(o_orderkey AS STRING), ' for customer ', c.c_name, ' in segment ', c.c_mktsegment) AS title
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""
VIEWS["backlog_rows"] = """
SELECT id, seq, home, state, structured, kind, date, hold_kind, hold_reason, body_excerpt, title
FROM backlog_base
UNION ALL
SELECT id, seq + 100000000000 AS seq, home, 'queued' AS state, structured, kind, date, hold_kind,
       hold_reason, body_excerpt, title
FROM backlog_base WHERE id % 13 = 0"""
VIEWS["backlog_mentions"] = """
SELECT id, seq, 0 AS pos, id - 1 AS blocker FROM backlog_rows WHERE structured AND id % 4 = 0
UNION ALL SELECT id, seq, 1 AS pos, id - 7 AS blocker FROM backlog_rows WHERE structured AND id % 4 = 0
UNION ALL SELECT id, seq, 2 AS pos, id + 900000000000 AS blocker
FROM backlog_rows WHERE structured AND id % 36 = 0"""
VIEWS["task_rows"] = """
SELECT o.o_orderkey AS id, o.o_orderkey AS task, o.o_orderkey AS seq, c.c_nationkey AS home,
       CASE WHEN o_orderkey % 23 = 0 THEN 'home' ELSE 'ship' END AS kind,
       o_orderkey % 31 <> 0 AS reachable,
       CASE WHEN o_orderkey % 7 = 0 THEN 'working' WHEN o_orderkey % 7 = 1 THEN 'parked'
            WHEN o_orderkey % 7 = 2 THEN 'done' WHEN o_orderkey % 7 = 3 THEN 'failed'
            WHEN o_orderkey % 7 = 4 THEN 'paused' WHEN o_orderkey % 7 = 5 THEN 'blocked'
            ELSE 'unknown' END AS state
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o_orderkey % 3 <> 0"""
VIEWS["registry_rows"] = """
SELECT CAST(n_nationkey AS BIGINT) AS id, concat('/homes/', n_name) AS home,
       CASE WHEN n_nationkey % 8 = 3 THEN 'registry entry has no home' END AS registry_error
FROM nation WHERE n_nationkey % 5 <> 0"""
VIEWS["report_rows"] = """
SELECT o_orderkey AS id, concat('data/', CAST(o_orderkey AS STRING), '/report.md') AS path
FROM orders WHERE o_orderkey % 4 = 0"""

# timings: one script per part.
VIEWS["timings"] = """
SELECT concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)) AS path, p_type AS family,
       p_brand AS lane, CAST(p_size * 1000 + p_partkey % 997 AS BIGINT) AS duration_ms,
       CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS exit, p_partkey % 29 = 0 AS gate_skip
FROM part"""

# briefs: documents with common words replaced, so that the risk vocabulary occurs.
VIEWS["briefs"] = """
SELECT doc_id, lang, source,
       replace(replace(replace(replace(replace(text, ' the ', ' session '), ' of ', ' token '),
               ' and ', ' key '), ' de ', ' access control '), ' that ', ' migration ') AS text
FROM documents"""


def _refs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [name for name in VIEWS if name in words]


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _order(names: list[str]) -> list[str]:
    """Views needed for ``names``, each after the views it reads."""
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in _refs(VIEWS[name]):
            if dep != name and dep not in out:
                visit(dep)
        if name not in out:
            out.append(name)

    for n in names:
        visit(n)
    return out


def with_views(sql: str) -> str:
    """Prefix a DuckDB statement with the views it mentions."""
    epoch = re.compile(r"@EPOCH\((\w+)\)@")
    names = _order(_refs(sql))
    body = [f"{n} AS ({epoch.sub(r'(epoch_us(\1) // 1000000)', VIEWS[n])}\n)" for n in names]
    sql = sql.strip()
    if not body:
        return sql
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return head + ",\n".join(body) + ",\n" + sql[len(head):]
    return "WITH " + ",\n".join(body) + "\n" + sql


_SPARK_EPOCH = (
    r"(CAST(datediff(to_date(\1), DATE'1970-01-01') AS BIGINT) * 86400"
    r" + hour(\1) * 3600 + minute(\1) * 60 + second(\1))"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame. Only lazy plans; Catalyst prunes columns down to the scan."""
    built: dict[str, DataFrame] = {}
    for n in _order([name]):
        sql = re.sub(r"@EPOCH\((\w+)\)@", _SPARK_EPOCH, VIEWS[n])
        args: dict[str, DataFrame] = {}
        for dep in [*built, *TABLES]:
            pattern = rf"\b(FROM|JOIN)\s+{dep}\b"
            if re.search(pattern, sql):
                sql = re.sub(pattern, rf"\1 {{{dep}}}", sql)
                args[dep] = built[dep] if dep in built else table(spark, sf_dir, dep)
        built[n] = spark.sql(sql, **args)
    return built[name]


def view_over(spark: SparkSession, name: str, **sources: DataFrame) -> DataFrame:
    """A view over given DataFrames instead of the tables, for streams."""
    built = dict(sources)
    for n in _order([name]):
        sql = re.sub(r"@EPOCH\((\w+)\)@", _SPARK_EPOCH, VIEWS[n])
        args = {}
        for dep in built:
            pattern = rf"\b(FROM|JOIN)\s+{dep}\b"
            if re.search(pattern, sql):
                sql = re.sub(pattern, rf"\1 {{{dep}}}", sql)
                args[dep] = built[dep]
        built[n] = spark.sql(sql, **args)
    return built[name]
