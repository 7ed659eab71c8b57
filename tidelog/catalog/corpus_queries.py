"""Corpus jobs over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import query
from tidelog.catalog.views import table, view, with_views
from tidelog.operators import corpus
from tidelog.plans import risk


def task_briefs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as briefs: every other one has a task section, fences, prohibitions and a scope
    heading around its text."""
    text = F.col("text")
    framed = F.concat(
        F.lit("# Brief\n\nBackground token key.\n\n# Task\n\n## Work\n\n"), text,
        F.lit("\n\n- Do not touch the session cookie. Update the login page, but never the schema.\n\n"
              "## Out of scope\n\nThe access control list.\n\n## Code\n\n```\n# Rules\nnever drop the password\n```\n\n"
              "# Rules\n\nRotate every secret.\n"))
    return view(spark, sf, "briefs").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, framed).otherwise(text).alias("text"))


@query("scope_clauses")
def scope_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.scope_clauses(task_briefs(spark, sf))


@query("chunk_texts")
def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunk_texts(table(spark, sf, "documents"), 280, 25)


_CLAUSES = """
c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS clause_no FROM briefs),
w AS (SELECT doc_id, clause_no, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM c),
t AS (SELECT doc_id, clause_no, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
n AS (SELECT *, lag(w, 1) OVER s AS l1, lead(w, 1) OVER s AS r1, lag(w, 2) OVER s AS l2, lead(w, 2) OVER s AS r2 FROM t
  WINDOW s AS (PARTITION BY doc_id, clause_no ORDER BY i))"""
_NEAR = f"'^({corpus.PAIR_QUALIFIERS}|{corpus.PAIR_HEADS})$'"
_PAIR = f"""CASE WHEN regexp_matches(l1, {_NEAR}) THEN l1 || ' ' || w WHEN regexp_matches(r1, {_NEAR}) THEN w || ' ' || r1
  WHEN regexp_matches(l2, {_NEAR}) THEN l2 || ' ' || w WHEN regexp_matches(r2, {_NEAR}) THEN w || ' ' || r2 END"""


@query("pair_hits", with_views(f"""
WITH {_CLAUSES}, h AS (SELECT doc_id, clause_no, {_PAIR} AS pair FROM n WHERE regexp_matches(w, '^({corpus.PAIR_HEADS})$'))
SELECT doc_id, CAST(clause_no AS BIGINT) AS clause_no, pair, count(*) AS hits FROM h WHERE pair IS NOT NULL GROUP BY ALL"""))
def pair_hits(spark: SparkSession, sf: str) -> DataFrame:
    clauses = corpus.spread(view(spark, sf, "briefs").select("doc_id", "text")).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("clause_no", "text"))
    return corpus.pair_hits(clauses).groupBy(
        "doc_id", F.col("clause_no").cast("long").alias("clause_no"), "pair").agg(F.count("*").alias("hits"))


@query("risk_terms", with_views(f"""
WITH {_CLAUSES},
f AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM briefs),
h AS (SELECT doc_id, {_PAIR} AS hit FROM n WHERE regexp_matches(w, '^({corpus.PAIR_HEADS})$')
  UNION ALL SELECT doc_id, w FROM n WHERE regexp_matches(w, '^({corpus.RISK_WORDS}){corpus.RISK_SUFFIX}$')
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(array_to_string(ws, ' '), '({corpus.RISK_PHRASES}){corpus.RISK_SUFFIX}')) FROM f),
d AS (SELECT DISTINCT doc_id, hit FROM h WHERE hit IS NOT NULL),
s AS (SELECT doc_id, string_agg(hit, ',' ORDER BY hit) AS hits FROM d GROUP BY doc_id)
SELECT b.doc_id, coalesce(s.hits, '') AS hits FROM briefs b LEFT JOIN s ON s.doc_id = b.doc_id"""))
def risk_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = corpus.risk_terms(corpus.narrow_scope(view(spark, sf, "briefs")))
    return terms.select("doc_id", F.array_join("hits", ",").alias("hits"))


@query("risk_scan")
def risk_scan(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    paths = part.select(
        (F.col("p_partkey") % 700).alias("doc_id"),
        F.concat(F.lit("src/"), F.when(F.col("p_size") % 9 == 0, "auth").otherwise("view"), F.lit("/"),
                 F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit(".py")).alias("path"))
    blind = table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    return risk.risk_scan(task_briefs(spark, sf), paths, blind)
