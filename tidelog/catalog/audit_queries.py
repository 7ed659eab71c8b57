"""Audits of links, traces, messages, ceilings, tests and path ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import query
from tidelog.catalog.views import table
from tidelog.functions import text as tx
from tidelog.operators import audits
from tidelog.vocab import MESSAGE_KINDS, MESSAGE_MARK


@query("audit_change_urls", """
WITH u AS (SELECT o_orderkey AS n, CASE o_orderkey % 12
   WHEN 0 THEN concat('https://github.com/team', CAST(o_custkey % 9 AS VARCHAR), '/repo/pull/', CAST(o_orderkey + 1 AS VARCHAR))
   WHEN 1 THEN concat('https://github.com/a--b/repo/pull/', CAST(o_orderkey AS VARCHAR))
   WHEN 2 THEN concat('https://github.com/a/../pull/', CAST(o_orderkey AS VARCHAR))
   WHEN 3 THEN concat('https://github.com/a/repo/pull/0', CAST(o_orderkey AS VARCHAR))
   WHEN 4 THEN concat('https://git.example.com/g', CAST(o_custkey % 7 AS VARCHAR), '/sub/proj/-/merge_requests/', CAST(o_orderkey AS VARCHAR))
   WHEN 5 THEN concat('https://git.example.com/proj/-/merge_requests/', CAST(o_orderkey AS VARCHAR))
   WHEN 6 THEN concat('https://github.com/o/r/-/merge_requests/', CAST(o_orderkey AS VARCHAR))
   WHEN 7 THEN concat('https://git..example.com/g/p/-/merge_requests/', CAST(o_orderkey AS VARCHAR))
   WHEN 8 THEN concat('https://git.example.com/g/p.git/-/merge_requests/', CAST(o_orderkey AS VARCHAR))
   WHEN 9 THEN concat('https://-git.example.com/g/p/-/merge_requests/', CAST(o_orderkey AS VARCHAR))
   WHEN 10 THEN concat('https://git.example.com/g/-/merge_requests/1/-/merge_requests/', CAST(o_orderkey AS VARCHAR))
   ELSE 'see the change' END AS url FROM orders),
p AS (SELECT *, CASE WHEN n % 12 = 0 THEN 'github' WHEN n % 12 = 4 THEN 'gitlab' ELSE 'rejected' END AS provider FROM u)
SELECT provider, count(*) AS links, count(DISTINCT CASE WHEN provider <> 'rejected' THEN regexp_replace(url, '/[^/]*$', '') END) AS repos,
  coalesce(max(CASE WHEN provider <> 'rejected' THEN length(regexp_extract(url, '[0-9]+$')) END), 0) AS number_digits
FROM p GROUP BY provider""")
def audit_change_urls(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    s, shape = n.cast("string"), n % 12
    cust = F.col("o_custkey")

    def url(*parts) -> F.Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    shapes = [
        url("https://github.com/team", (cust % 9).cast("string"), "/repo/pull/", (n + 1).cast("string")),
        url("https://github.com/a--b/repo/pull/", s), url("https://github.com/a/../pull/", s),
        url("https://github.com/a/repo/pull/0", s),
        url("https://git.example.com/g", (cust % 7).cast("string"), "/sub/proj/-/merge_requests/", s),
        url("https://git.example.com/proj/-/merge_requests/", s), url("https://github.com/o/r/-/merge_requests/", s),
        url("https://git..example.com/g/p/-/merge_requests/", s), url("https://git.example.com/g/p.git/-/merge_requests/", s),
        url("https://-git.example.com/g/p/-/merge_requests/", s),
        url("https://git.example.com/g/-/merge_requests/1/-/merge_requests/", s),
    ]
    text = F.lit("see the change")
    for i, made in enumerate(shapes):
        text = F.when(shape == i, made).otherwise(text)
    return audits.audit_change_urls(table(spark, sf, "orders").select(text.alias("url")))


@query("audit_traces", """
WITH t AS (SELECT l_suppkey AS source, l_orderkey AS task, CASE WHEN l_partkey % 11 = 0 THEN concat('00-', repeat('0', 32), '-', substr(md5('s'), 1, 16), '-01')
    WHEN l_partkey % 11 = 1 THEN concat('00-', md5(CAST(l_partkey AS VARCHAR)), '-', repeat('0', 16), '-01')
    WHEN l_partkey % 11 = 2 THEN concat('00-', upper(md5(CAST(l_partkey AS VARCHAR))), '-', substr(md5('s'), 1, 16), '-01')
    WHEN l_partkey % 11 = 3 THEN NULL
    ELSE concat('00-', md5(CAST(l_partkey % 300 AS VARCHAR)), '-', substr(md5('s'), 1, 16), '-01') END AS tp, l_partkey FROM lineitem),
v AS (SELECT source, task, CASE WHEN l_partkey % 11 > 3 THEN substr(tp, 4, 32) END AS trace FROM t),
g AS (SELECT source, trace, count(*) AS n, count(DISTINCT task) AS tasks FROM v GROUP BY source, trace)
SELECT source, CAST(sum(n) AS BIGINT) AS spans, CAST(coalesce(sum(n) FILTER (WHERE trace IS NULL), 0) AS BIGINT) AS invalid, count(trace) AS traces,
  coalesce(max(tasks) FILTER (WHERE trace IS NOT NULL), 0) AS widest FROM g GROUP BY source""")
def audit_traces(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("l_partkey")
    span, zero = F.substring(F.md5(F.lit("s")), 1, 16), F.lit("0" * 16)
    own = F.md5(part.cast("string"))
    shape = part % 11

    def header(trace, span_id):
        return F.concat(F.lit("00-"), trace, F.lit("-"), span_id, F.lit("-01"))

    tp = (F.when(shape == 0, header(F.lit("0" * 32), span)).when(shape == 1, header(own, zero))
          .when(shape == 2, header(F.upper(own), span))
          .when(shape != 3, header(F.md5((part % 300).cast("string")), span)))
    return audits.audit_traces(table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("task"), tp.alias("traceparent")))


_LABEL = "SUPERVISOR_OP"


@query("provenance_counts", f"""
WITH m AS (SELECT conv_id, CASE WHEN turn % 5 = 0 THEN concat('{MESSAGE_MARK}{_LABEL}: v1 watcher: ', text)
    WHEN turn % 5 = 1 THEN concat('{MESSAGE_MARK}{_LABEL}: v1 ', role, ': ', text) WHEN turn % 5 = 2 THEN '{MESSAGE_MARK}{_LABEL}: v1 launch-brief: '
    WHEN turn % 5 = 3 THEN concat('{_LABEL}: v1 watcher: ', text) ELSE text END AS text FROM conversations),
k AS (SELECT conv_id, regexp_extract(text, '^{MESSAGE_MARK}{_LABEL}: v1 ([^:]*): ', 1) AS kind,
    length(regexp_replace(text, '^{MESSAGE_MARK}{_LABEL}: v1 [^:]*: ', '')) AS rest FROM m)
SELECT conv_id, CASE WHEN kind IN ('session-start', 'watcher', 'turn-end-guard', 'away-supervisor', 'launch-brief') AND rest > 0 THEN kind ELSE 'ordinary' END AS kind,
  count(*) AS messages FROM k GROUP BY 1, 2""")
def provenance_counts(spark: SparkSession, sf: str) -> DataFrame:
    head = F.lit(f"{MESSAGE_MARK}{_LABEL}: v1 ")
    turn, text = F.col("turn") % 5, F.col("text")
    wrapped = (F.when(turn == 0, F.concat(head, F.lit("watcher: "), text))
               .when(turn == 1, F.concat(head, "role", F.lit(": "), text))
               .when(turn == 2, F.concat(head, F.lit("launch-brief: ")))
               .when(turn == 3, F.concat(F.lit(f"{_LABEL}: v1 watcher: "), text)).otherwise(text))
    rows = table(spark, sf, "conversations").select("conv_id", wrapped.alias("text"))
    return audits.provenance_counts(rows, _LABEL, MESSAGE_KINDS)


@query("tier_breaches", """
WITH t AS (SELECT o_orderkey AS task, o_orderkey % 3 = 0 AS trivial, o_custkey % 12 AS files, o_custkey % 500 AS lines, o_orderkey % 4000 AS age_secs FROM orders)
SELECT task, 'trivial-size' AS breach FROM t WHERE trivial AND (files > 2 OR lines > 30)
UNION ALL SELECT task, 'trivial-age' FROM t WHERE trivial AND age_secs > 1800
UNION ALL SELECT task, 'heavy-size' FROM t WHERE files > 8 OR lines > 400""")
def tier_breaches(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        key.alias("task"), (key % 3 == 0).alias("trivial"), (cust % 12).alias("files"), (cust % 500).alias("lines"),
        (key % 4000).alias("age_secs"))
    return audits.tier_breaches(rows).select("task", "breach")


@query("classify_tests", """
SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS name, CASE WHEN p_partkey % 6 = 0 THEN 'unclassified' ELSE p_type END AS family,
  p_partkey % 5 IN (0, 1) AS gate_skip FROM part""")
def classify_tests(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.concat_ws(" ", "p_name", key.cast("string"))
    shape = key % 5
    output = (F.when(shape == 0, "skip: no binary\nok").when(shape == 1, "\n   \nskip: gated")
              .when(shape == 2, "ok\nskip: late").when(shape == 3, "").otherwise("fine"))
    part = table(spark, sf, "part")
    families = part.filter("p_partkey % 6 <> 0").select(name.alias("name"), F.col("p_type").alias("family"))
    return audits.classify_tests(part.select(name.alias("name"), output.alias("output")), families).select(
        "name", "family", "gate_skip")


@query("impacted_families", """
WITH p AS (SELECT concat(CASE WHEN p_size % 5 = 0 THEN 'src/' WHEN p_size % 5 = 1 THEN 'tests/' WHEN p_size % 5 = 2 THEN 'docs/' ELSE 'lib/' END,
    replace(p_name, ' ', '/'), '/', lower(p_type), CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.md' END) AS path FROM part)
SELECT path, f.family, count(*) AS paths FROM p, (SELECT unnest(['unit', 'e2e', 'docs-check', 'unmapped']) AS family) f
WHERE CASE WHEN regexp_matches(path, '^src/.*[.]py$') THEN f.family IN ('unit', 'e2e') WHEN regexp_matches(path, '^tests/') THEN f.family = 'unit'
  WHEN regexp_matches(path, '^docs/.*[.]md$') THEN f.family = 'docs-check' WHEN regexp_matches(path, '[.]md$') THEN false ELSE f.family = 'unmapped' END
GROUP BY path, f.family""")
def impacted_families(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 5
    folder = F.when(size == 0, "src/").when(size == 1, "tests/").when(size == 2, "docs/").otherwise("lib/")
    path = F.concat(folder, F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit("/"), F.lower("p_type"),
                    F.when(F.col("p_partkey") % 2 == 0, ".py").otherwise(".md"))
    rules = [(r"^src/.*\.py$", ["unit", "e2e"]), ("^tests/", ["unit"]), (r"^docs/.*\.md$", ["docs-check"]), (r"\.md$", [])]
    paths = table(spark, sf, "part").select(path.alias("path"))
    return audits.impacted_families(paths, rules).groupBy("path", "family").agg(F.count("*").alias("paths"))


@query("tests_referencing", """
WITH n AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS name FROM part UNION SELECT DISTINCT substr(md5(CAST(o_custkey AS VARCHAR)), 1, 3) FROM orders
  UNION SELECT w FROM (VALUES ('the'), ('of'), ('once'), ('de'), ('is.')) v(w))
SELECT n.name, d.doc_id AS test FROM documents d JOIN n ON contains(d.text, n.name)""")
def tests_referencing(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name"))
    names = names.unionByName(table(spark, sf, "orders").select(
        F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 3).alias("name")))
    fixed = table(spark, sf, "region").select(F.explode(F.array(*[
        F.lit(w) for w in ("the", "of", "once", "de", "is.")])).alias("name"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("test"), "text")
    return audits.tests_referencing(names.unionByName(fixed), docs)


@query("overlapping_paths", """
WITH p AS (SELECT DISTINCT CASE WHEN c_custkey % 50 = 0 THEN concat('/h/', CAST(c_nationkey AS VARCHAR))
    ELSE concat('/h/', CAST(c_nationkey AS VARCHAR), '/', CAST(c_custkey % 300 AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN '/x' ELSE '' END) END AS path,
    concat('m', CAST(c_custkey % 1100 AS VARCHAR)) AS id FROM customer),
b AS (SELECT path, count(*) AS n, min(id) AS id FROM p GROUP BY path), i AS (SELECT id, count(*) AS n, min(path) AS path FROM p GROUP BY id)
SELECT 'contained' AS kind, o.path, o.id, c.path AS other, 2 AS n FROM b o JOIN b c ON o.path <> c.path AND starts_with(c.path, o.path || '/')
UNION ALL SELECT 'duplicate-path', path, id, NULL, n FROM b WHERE n > 1
UNION ALL SELECT 'duplicate-id', path, id, NULL, n FROM i WHERE n > 1""")
def overlapping_paths(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    home = F.concat(F.lit("/h/"), F.col("c_nationkey").cast("string"))
    inner = F.concat(home, F.lit("/"), (key % 300).cast("string"), F.when(key % 3 == 0, "/x").otherwise(""))
    owned = table(spark, sf, "customer").select(
        F.when(key % 50 == 0, home).otherwise(inner).alias("path"),
        F.concat(F.lit("m"), (key % 1100).cast("string")).alias("id"))
    return audits.overlapping_paths(owned)


def site(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pages as local files: one folder per host; markdown pages link to neighbours and anchors."""
    n = F.col("page_id")
    path = F.concat(F.lit("s"), (n % 9).cast("string"), F.lit("/p"), n.cast("string"), F.lit(".md"))
    near = F.concat(F.lit("p"), (n + 9).cast("string"), F.lit(".md"))
    body = F.concat(
        F.lit("# Start here\n\n## Part `one`\n\n## Part one ##\n<a name=\"deep\">x</a>\n[next]("), near,
        F.lit("#part-one-1)\n[gone]("), near, F.lit("#no-such)\n[self](#start-here) [up](../s"), ((n + 1) % 9).cast("string"),
        F.lit("/p"), (n + 1).cast("string"), F.lit(".md) [out](../../etc.md) [web](https://example.com/a#b) ![pic](<img/a%20b.png> \"t\")\n"))
    pages = table(spark, sf, "pages").select(path.alias("path"), F.concat(body, "html").alias("text"))
    inventory = table(spark, sf, "pages").filter("page_id % 20 <> 3").select(path.alias("path"), F.lit("all").alias("audience"))
    again = table(spark, sf, "pages").filter("page_id % 40 = 7").select(path.alias("path"), F.lit("some").alias("audience"))
    ghost = table(spark, sf, "pages").filter("page_id % 50 = 9").select(
        F.concat(path, F.lit(".old")).alias("path"), F.lit("all").alias("audience"))
    return pages, inventory.unionByName(again).unionByName(ghost)


@query("audit_links", r"""
WITH p AS (SELECT page_id AS n, concat('s', CAST(page_id % 9 AS VARCHAR), '/p', CAST(page_id AS VARCHAR), '.md') AS path, html FROM pages),
m AS (SELECT max(n) AS top FROM p),
h AS (SELECT path, unnest(regexp_extract_all(html, '\b(?:href|src)=["'']([^"'']+)["'']', 1)) AS raw FROM p)
SELECT 'unclassified' AS kind, path, path AS subject FROM p WHERE n % 20 = 3 AND n % 40 <> 7
UNION ALL SELECT 'duplicate', path, path FROM p WHERE n % 40 = 7
UNION ALL SELECT 'extra', concat(path, '.old'), concat(path, '.old') FROM p WHERE n % 50 = 9
UNION ALL SELECT 'absolute', path, raw FROM h WHERE starts_with(raw, '/') AND NOT starts_with(raw, '//')
UNION ALL SELECT 'escapes', path, '../../etc.md' FROM p
UNION ALL SELECT 'unresolved-link', path, concat('p', CAST(n + 9 AS VARCHAR), '.md', f) FROM p, m, (VALUES ('#part-one-1'), ('#no-such')) v(f) WHERE n + 9 > top
UNION ALL SELECT 'unresolved-link', path, concat('../s', CAST((n + 1) % 9 AS VARCHAR), '/p', CAST(n + 1 AS VARCHAR), '.md') FROM p, m WHERE n + 1 > top
UNION ALL SELECT 'unresolved-link', path, '<img/a%20b.png> "t"' FROM p
UNION ALL SELECT 'unresolved-link', path, raw FROM h WHERE NOT starts_with(raw, '/') AND NOT regexp_matches(raw, '^([A-Za-z][A-Za-z0-9+.-]*:|//)') AND NOT starts_with(raw, '#')
UNION ALL SELECT 'unresolved-anchor', path, concat('p', CAST(n + 9 AS VARCHAR), '.md#no-such') FROM p, m WHERE n + 9 <= top""")
def audit_links(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit_links(*site(spark, sf))


@query("message_kinds", f"""
SELECT conv_id, turn, 'ordinary' AS kind FROM conversations WHERE NOT starts_with(text, '{MESSAGE_MARK}')""")
def message_kinds(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    kind = tx.message_kind(F.col("text"), MESSAGE_KINDS, _LABEL)
    return rows.select("conv_id", "turn", kind.alias("kind"))


