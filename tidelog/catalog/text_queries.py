"""Line-level rules evaluated over whole logs and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import query
from tidelog.catalog.views import table, view, with_views
from tidelog.functions import text as tx
from tidelog.operators import audits
from tidelog.vocab import Vocabulary

# RE2 has no possessive quantifiers; the accepted shapes are spelled out instead. A shape followed
# by anything but whitespace (or by a bracket that is not closed) leaves the line alone.
_T = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_CLOCK = "([Tt ][0-9]{2}:[0-9]{2}(:[0-9]{2})?([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2}|[+-][0-9]{4}|[+-][0-9]{2})?)?"
_STRIPPED = f"""CASE WHEN regexp_matches(line, '^[ ]*[[]{_T}{_CLOCK}[]][ ]') THEN
      regexp_replace(line, '^[ ]*[[]{_T}{_CLOCK}[]][ ]+', '')
    WHEN regexp_matches(line, '^[ ]*{_T}{_CLOCK}[ ]') THEN
      regexp_replace(line, '^[ ]*{_T}{_CLOCK}[ ]+', '') ELSE line END"""


@query("strip_timestamps", with_views(f"SELECT seq, {_STRIPPED} AS text FROM stamped_lines"))
def strip_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "stamped_lines").select("seq", tx.strip_ts(F.col("line")).alias("text"))


@query("parse_status_lines", with_views(f"""
WITH t AS (SELECT seq, {_STRIPPED} AS text FROM stamped_lines),
h AS (SELECT seq, text, split_part(text, ':', 1) AS head FROM t)
SELECT seq, trim(CASE WHEN position('[key=' IN head) > 0
                 THEN substr(head, 1, position('[key=' IN head) - 1) ELSE head END) AS verb,
       CASE WHEN NOT regexp_matches(head, '[[]key=[^]]*[]]') THEN 'default'
            WHEN regexp_matches(regexp_extract(head, '[[]key=([^]]*)[]]', 1), '^[A-Za-z0-9._-]+$')
            THEN regexp_extract(head, '[[]key=([^]]*)[]]', 1) END AS key,
       CASE WHEN position(':' IN text) > 0 THEN ltrim(substr(text, position(':' IN text) + 1))
            ELSE text END AS note
FROM h"""))
def parse_status_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tx.parse_status(view(spark, sf, "stamped_lines")).select("seq", "verb", "key", "note")


@query("relevant_lines", with_views("""
SELECT task, verb, count(*) AS lines FROM (
  SELECT task, verb, line FROM status_events
  UNION ALL SELECT task, 'note' AS verb, concat('note: PR READY after ', note) AS line
  FROM status_events WHERE event_type = 'view') x
WHERE verb NOT IN ('working', 'resolved', 'captain-held', 'paused')
  AND (verb IN ('done', 'needs-decision', 'blocked', 'failed')
       OR regexp_matches(lower(line), 'done:|needs-decision:|blocked:|failed:|pr ready|checks green|ready in branch|merged'))
GROUP BY task, verb"""))
def relevant_lines(spark: SparkSession, sf: str) -> DataFrame:
    logs = view(spark, sf, "status_events")
    notes = logs.filter("event_type = 'view'").select(
        "task", F.lit("note").alias("verb"), F.concat(F.lit("note: PR READY after "), "note").alias("line"))
    rows = logs.select("task", "verb", "line").unionByName(notes)
    return rows.filter(tx.is_relevant(F.col("verb"), F.col("line"))).groupBy("task", "verb").agg(
        F.count("*").alias("lines"))


@query("relevant_lines_custom", with_views("""
SELECT task, count(*) AS lines FROM status_events
WHERE verb NOT IN ('working', 'resolved', 'captain-held', 'paused')
  AND regexp_matches(lower(line), 'k=?[12].*click') GROUP BY task"""))
def relevant_lines_custom(spark: SparkSession, sf: str) -> DataFrame:
    vocab = Vocabulary(relevant_text="k=?[12].*click")
    rows = view(spark, sf, "status_events")
    return rows.filter(tx.is_relevant(F.col("verb"), F.col("line"), vocab)).groupBy("task").agg(
        F.count("*").alias("lines"))


@query("verb_predicates", with_views("""
SELECT verb, verb = 'paused' AS paused, verb IN ('paused', 'captain-held') AS paused_or_held,
       verb IN ('done', 'needs-decision', 'blocked', 'failed') AS terminal,
       CASE verb WHEN 'paused' THEN 'paused' WHEN 'working' THEN 'working' WHEN 'blocked' THEN 'blocked'
            WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' WHEN 'needs-decision' THEN 'parked'
            ELSE 'unknown' END AS state, count(*) AS lines
FROM status_events GROUP BY ALL"""))
def verb_predicates(spark: SparkSession, sf: str) -> DataFrame:
    verb = F.col("verb")
    per_verb = view(spark, sf, "status_events").groupBy("verb").agg(F.count("*").alias("lines"))
    return per_verb.select(
        "verb", tx.is_paused(verb).alias("paused"), tx.is_paused_or_held(verb).alias("paused_or_held"),
        tx.is_terminal(verb).alias("terminal"), tx.verb_state(verb).alias("state"), "lines")


@query("reserved_key_guard", with_views("""
SELECT key, NOT starts_with(key, 'pending-reply-')
       OR (starts_with(note, 'pending-reply-') AND position(':' IN substr(note, 15)) > 0) AS allowed,
       count(*) AS lines
FROM status_events GROUP BY ALL"""))
def reserved_key_guard(spark: SparkSession, sf: str) -> DataFrame:
    allowed = tx.transition_allowed(F.col("key"), F.col("note"))
    return view(spark, sf, "status_events").groupBy("key", allowed.alias("allowed")).agg(
        F.count("*").alias("lines"))


@query("transition_policies", with_views("""
SELECT to_status, CASE WHEN to_status = 'blocked' THEN 'actionable' WHEN to_status = 'working' THEN 'absorb'
       WHEN to_status IN ('idle', 'done') THEN 'defer' ELSE 'fallback' END AS policy, count(*) AS edges
FROM transitions GROUP BY ALL"""))
def transition_policies(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "transitions").groupBy(
        "to_status", tx.transition_policy(F.col("to_status")).alias("policy")
    ).agg(F.count("*").alias("edges"))


@query("cap_long_lines", """
SELECT doc_id, CASE WHEN length(text) <= 220 THEN text
       ELSE substr(text, 1, 208) || ' [truncated]' END AS line FROM documents""")
def cap_long_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.cap_line(F.col("text")).alias("line"))


@query("ellipsize_titles", r"""
SELECT doc_id, CASE WHEN length(flat) > 90 THEN substr(flat, 1, 90) || '…' ELSE flat END AS title
FROM (SELECT doc_id, regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g') AS flat FROM documents)""")
def ellipsize_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.ellipsize(F.col("text"), 90).alias("title"))


@query("clean_control_text", """
SELECT doc_id, translate(text, chr(9) || chr(13) || chr(10), '   ') AS spaces,
  regexp_replace(regexp_replace(translate(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'),
    chr(9) || chr(10) || chr(13), '   '), ' +', ' ', 'g'), '^ | $', '', 'g') AS squeezed,
  regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '?', 'g') AS masked
FROM documents""")
def clean_control_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", tx.clean_text(text, "spaces").alias("spaces"),
        tx.clean_text(text, "squeeze").alias("squeezed"), tx.clean_text(text, "mask").alias("masked"))


_ROW_TEXT = """SELECT id, concat(title, ' https://forge.example.com/', CAST(home AS STRING), '/pull/', CAST(id AS STRING),
  ' (see <http://docs.example.com/', CAST(seq % 7 AS STRING), '>) (repo: r', CAST(home AS STRING), ', kind: ', kind,
  ') (since ', date, ')') AS rest FROM backlog_base WHERE date IS NOT NULL"""


@query("extract_links_and_meta", with_views(f"""
WITH r AS ({_ROW_TEXT})
SELECT id, array_to_string(regexp_extract_all(rest, 'https?://[^ )"<>]+'), ' ') AS links,
       regexp_extract(rest, 'https?://[^ )"<>]+/pull/[0-9]+') AS pr_url,
       trim(regexp_extract(rest, '.*([(]|, *)repo: *([^,)]*)', 2)) AS repo,
       trim(regexp_extract(rest, '.*([(]|, *)kind: *([^,)]*)', 2)) AS kind,
       trim(regexp_extract(rest, '.*([(]|, *)since +([^,)]*)', 2)) AS since
FROM r"""))
def extract_links_and_meta(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "backlog_base").filter("date IS NOT NULL").select(
        "id", F.expr("concat(title, ' https://forge.example.com/', home, '/pull/', id, "
                     "' (see <http://docs.example.com/', seq % 7, '>) (repo: r', home, ', kind: ', kind, "
                     "') (since ', date, ')')").alias("rest"))
    rest = F.col("rest")
    links = tx.extract_links(rest)
    return rows.select(
        "id", F.array_join(links, " ").alias("links"), tx.first_change_link(links).alias("pr_url"),
        tx.extract_meta(rest, "repo").alias("repo"), tx.extract_meta(rest, "kind").alias("kind"),
        tx.extract_meta_word(rest, "since").alias("since"))


@query("check_rollups", """
WITH c AS (SELECT l_orderkey AS pr, l_shipdate IS NOT NULL AS any_check,
    CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'FAILURE'
         WHEN l_returnflag = 'A' THEN 'SUCCESS' END AS conclusion,
    CASE WHEN l_linestatus = 'O' AND l_linenumber = 2 THEN 'QUEUED' ELSE 'COMPLETED' END AS status,
    CASE WHEN l_returnflag = 'N' THEN 'SUCCESS' END AS state FROM lineitem)
SELECT o_orderkey AS pr, CASE WHEN count(c.pr) = 0 THEN 'none'
    WHEN bool_or(coalesce(conclusion, state, '') IN ('FAILURE','ERROR','TIMED_OUT','CANCELLED','ACTION_REQUIRED')) THEN 'failing'
    WHEN bool_or(coalesce(status, '') <> 'COMPLETED' AND coalesce(state, '') <> 'SUCCESS') THEN 'pending'
    ELSE 'passing' END AS checks
FROM orders LEFT JOIN c ON c.pr = o_orderkey GROUP BY o_orderkey""")
def check_rollups(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    conclusion = F.when((flag == "R") & (number % 3 == 0), "FAILURE").when(flag == "A", "SUCCESS")
    status = F.when((F.col("l_linestatus") == "O") & (number == 2), "QUEUED").otherwise("COMPLETED")
    state = F.when(flag == "N", "SUCCESS")
    checks = F.struct(conclusion.alias("conclusion"), state.alias("state"), status.alias("status"))
    # The checks of one change are the lines of one order: a bounded nested array, as in the source.
    per_pr = l.select(F.col("l_orderkey").alias("pr"), checks.alias("c")).groupBy("pr").agg(
        F.collect_set("c").alias("checks"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pr"))
    return orders.join(per_pr, "pr", "left").select("pr", tx.check_rollup(F.col("checks")).alias("checks"))


@query("superseded_rows", with_views("""
SELECT id FROM backlog_base
WHERE NOT regexp_matches(upper(coalesce(body_excerpt, '')), 'SUPERSEDED|NOT REQUIRED|NOT-REQUIRED|DEFERRED')"""))
def superseded_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "backlog_base")
    return rows.filter(~tx.is_superseded(F.col("body_excerpt"))).select("id")


@query("token_estimates", "SELECT doc_id, CAST(ceil(strlen(text) / 3.0) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.est_tokens(F.col("text")).alias("tokens"))


@query("failed_log_lines", with_views("""
WITH d AS (SELECT task, CASE WHEN event_type = 'error' THEN concat('2024-01-01T00:00:00Z FAILED: code ', CAST(k % 4 AS STRING))
    WHEN k % 7 = 0 THEN concat('ALERT raised ', note) WHEN k % 7 = 1 THEN 'ALERTS are off'
    ELSE concat('ok ', note) END AS line FROM status_events)
SELECT task, count(*) AS failed FROM d
WHERE regexp_matches(line, 'STUCK:|FAILED:|needs attention|(^|[ ])ALERT([ ]|$)') GROUP BY task"""))
def failed_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "status_events").select("task", deploy_line().alias("line"))
    return rows.filter(tx.line_failed(F.col("line"))).groupBy("task").agg(F.count("*").alias("failed"))


def deploy_line():
    k, note = F.col("k"), F.col("note")
    return (
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("2024-01-01T00:00:00Z FAILED: code "), (k % 4).cast("string")))
        .when(k % 7 == 0, F.concat(F.lit("ALERT raised "), note))
        .when(k % 7 == 1, "ALERTS are off")
        .otherwise(F.concat(F.lit("ok "), note)))


@query("derived_event_ids", """
SELECT o_orderkey AS id, sha256(concat(CAST(o_orderkey AS VARCHAR), chr(31), CAST(o_custkey AS VARCHAR), chr(31),
       o_orderstatus, chr(31), coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, ''))) AS event_id
FROM orders""")
def derived_event_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    optional = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), tx.derive_event_id(
        F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), optional).alias("event_id"))


@query("correlation_tokens", with_views("""
SELECT seq, lower(regexp_extract(line, 'corr=([A-Fa-f0-9]{16})', 1)) AS corr,
       CASE WHEN regexp_matches(line, 'data/.*report|report[.]md|document|pointer') THEN 'document'
            WHEN regexp_matches(line, 'via-helper|mate-report') THEN 'helper' ELSE 'status' END AS via
FROM report_lines WHERE regexp_matches(line, 'corr=[A-Fa-f0-9]{16}') AND NOT contains(line, 'pending-reply-missed')"""))
def correlation_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = tx.computed(view(spark, sf, "report_lines"), corr=tx.extract_corr(F.col("line")))
    return rows.filter("corr IS NOT NULL").select("seq", "corr", tx.resolve_via(F.col("line")).alias("via"))


@query("risky_paths", """
WITH p AS (SELECT p_partkey AS doc_id, concat('src/', replace(p_name, ' ', '_'), '/',
    CASE WHEN p_size % 6 = 0 THEN 'auth' WHEN p_size % 6 = 1 THEN 'run-migration'
         WHEN p_size % 6 = 2 THEN 'session' WHEN p_size % 6 = 3 THEN 'session-list'
         WHEN p_size % 6 = 4 THEN 'authors' ELSE 'config.schema' END, '.',
    lower(p_type)) AS path FROM part),
c AS (SELECT doc_id, path, unnest(string_split(lower(path), '/')) AS comp FROM p),
s AS (SELECT doc_id, path, comp, regexp_replace(comp, '[.][^.]*$', '') AS stem FROM c)
SELECT DISTINCT doc_id, path FROM s
WHERE list_contains(['auth','session','migration','schema','token','secret'], comp)
   OR list_contains(['auth','session'], stem)
   OR len(list_filter(string_split(replace(replace(stem, '-', '.'), '_', '.'), '.'), lambda t: list_contains(['auth','migration','schema'], t))) > 0""")
def risky_paths(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 6
    base = (F.when(size == 0, "auth").when(size == 1, "run-migration").when(size == 2, "session")
            .when(size == 3, "session-list").when(size == 4, "authors").otherwise("config.schema"))
    path = F.concat(F.lit("src/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("/"), base,
                    F.lit("."), F.lower("p_type"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), path.alias("path"))
    return audits.risky_paths(rows)
