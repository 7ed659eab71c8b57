"""URL filters: exact membership by a cascade of Bloom filters, beside host and path rules.

The listed keys go into the filter of level 0. Those keys of the corpus that are not listed but pass it go into
level 1, the listed ones that pass level 1 go into level 2, and so on until nothing passes by mistake. As every key
of the corpus took part, the level at which a key first fails tells exactly whether it is listed, and pages are
judged in their scan, without a join.

All of it is DataFrame functions: bits are set by ``bit_or`` aggregates over words of 64, and tested by ``bit_get``.

Nulls and odd cases: a null url, or one without ``://``, has empty host and path and is judged as that key. Repeated
urls are one key. An empty table gives an empty result. Other columns of the pages are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.base import query, stage, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (verdict, host and path of the rule). The longest rule that fits a url wins.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Query parameters that mark a tracked link; a page address that was ever linked so is listed.
TRACKED = r"[?&](utm_[a-z]+|ref)="


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for outcome, text in sorted(rules, key=lambda r: len(r[1])):
        owner, slash, rest = text.partition("/")
        fits = ((host == owner) | host.endswith(f".{owner}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    """One filter: rows of ``(shard, words)``, ``words`` being the shard's bits in 64-bit integers."""

    words: DataFrame
    n_bits: int


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]
    n_shards: int
    n_hashes: int

    def _positions(self, key: Column, level: int) -> list[Column]:
        n_bits = self.levels[level].n_bits
        first = F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(n_bits))
        step = F.pmod(F.xxhash64(F.lit(2 * level + 1), key), F.lit(n_bits - 1)) + 1
        return [F.pmod(first + step * i, F.lit(n_bits)) for i in range(self.n_hashes)]

    def _passes(self, key: Column, level: int, words: Column) -> Column:
        test = F.lit(True)
        for at in self._positions(key, level):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            test = test & (F.bit_get(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return F.coalesce(test, F.lit(False))

    def mark(self, df: DataFrame, key: Column, name: str = "listed") -> DataFrame:
        """Add whether the key is listed; exact for every key of the universe that the cascade was built over.
        One shard: the words are scalar subqueries, so rows are judged in their scan. More shards, for lists whose
        bits pass the bound: the rows meet the words of their shard."""
        words: list[Column] = []
        if self.n_shards == 1:
            words = [level.words.select("words").scalar() for level in self.levels]
        else:
            df = df.withColumn("__shard", shard_of(key, self.n_shards))
            for i, level in enumerate(self.levels):
                df = df.join(level.words.select(F.col("shard").alias("__shard"), F.col("words").alias(f"__words_{i}")),
                             "__shard", "left")
                words.append(F.col(f"__words_{i}"))
        listed = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            listed = F.when(~self._passes(key, i, words[i]), F.lit(i % 2 == 1)).otherwise(listed)
        return df.withColumn(name, listed).drop("__shard", *[f"__words_{i}" for i in range(len(self.levels))])


def shard_of(key: Column, n_shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(n_shards)).cast("int")


def build_cascade(
    keys: DataFrame, *, bits_per_key: int = 10, n_hashes: int = 5, max_words: int = 1 << 17, max_levels: int = 64
) -> Cascade:
    """``keys`` has a distinct string ``key`` and a boolean ``listed`` for every key that will ever be asked.

    ``max_words`` bounds the words of one filter that are handed to a task at once (1 MB); longer lists are cut
    into shards by a hash of the key. Every level is far smaller than the one before it."""
    spark = keys.sparkSession
    keys = stage(keys.select("key", "listed"))
    n_shards = max(1, -(-keys.filter("listed").count() * bits_per_key // (64 * max_words)))
    levels: list[Level] = []
    members, others = keys.filter("listed"), keys.filter("NOT listed")
    while True:
        level = len(levels)
        if level == max_levels:
            raise RuntimeError(f"the cascade did not end within {max_levels} levels")
        size = members.count()
        n_bits = max(128, 64 * -(-size * bits_per_key // (64 * n_shards)))
        probe = Cascade((*levels, Level(members, n_bits)), n_shards, n_hashes)
        bits = members.select(
            shard_of(F.col("key"), n_shards).alias("shard"),
            F.explode(F.array(*probe._positions(F.col("key"), level))).alias("at"),
        )
        words = bits.groupBy("shard", F.shiftright("at", 6).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")
        )
        every = spark.range(n_shards).select(
            F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_bits // 64 - 1))).alias("word")
        )
        filled = every.join(words, ["shard", "word"], "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
        packed = filled.groupBy("shard").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")
        )
        levels.append(Level(stage(packed), n_bits))
        cascade = Cascade(tuple(levels), n_shards, n_hashes)
        # Only keys that pass every level so far are still open; they are the others' false positives.
        passed = _passing(cascade, others)
        if passed.isEmpty():
            return cascade
        members, others = passed, members


def _passing(cascade: Cascade, keys: DataFrame) -> DataFrame:
    """The keys that pass the last level."""
    last = len(cascade.levels) - 1
    words = cascade.levels[last].words
    if cascade.n_shards == 1:
        return stage(keys.filter(cascade._passes(F.col("key"), last, words.select("words").scalar())))
    met = keys.withColumn("shard", shard_of(F.col("key"), cascade.n_shards)).join(words, "shard")
    return stage(met.filter(cascade._passes(F.col("key"), last, F.col("words"))).select("key", "listed"))


def judge(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page. Listed are the addresses (host and path) that some page
    of the corpus names with a tracking parameter."""
    parts = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.coalesce(F.col("url").rlike(TRACKED), F.lit(False)).alias("tracked"),
    )
    universe = parts.groupBy(F.concat("host", "path").alias("key")).agg(F.max("tracked").alias("listed"))
    cascade = build_cascade(universe, **options)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    marked = cascade.mark(parts, F.concat("host", "path"))
    return marked.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )


SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_matches(url, '[?&](utm_[a-z]+|ref)='), false) AS tracked
  FROM (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)
),
listed AS (SELECT DISTINCT host || path AS key FROM parts WHERE tracked),
rules(verdict, rule, owner, prefix) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
best AS (
  SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.owner OR ends_with(p.host, '.' || r.owner)) AND starts_with(p.path, r.prefix)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule,
  coalesce(b.verdict, CASE WHEN p.host || p.path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
"""


@query("op6_url_filter", SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
