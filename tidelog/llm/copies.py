"""Exact dedup: documents of equal text, found by a 128-bit hash and proven byte by byte.

Groups are those of the first 128 bits of the text's SHA-256. Only this key, the id and a row number travel for the
grouping. A second pass groups whole texts by key and bytes (combined before the shuffle, so a group of copies sends one
text a task) and names the keys under which different texts lie; their rows, and no others, are grouped anew by key and
text. A group is never gathered: its keeper and its size are plain aggregates, joined back on the key.

Nulls and odd cases: null counts as empty, and is a copy of the empty text; a row without an id stays only where no copy
has one (its ``keep_id`` is then null); of rows that share the id that stays, the first as read is kept and the others are
not, so one row of every group stays; an empty table gives an empty result. Other columns are ignored by ``mark_copies``
and returned by ``drop_copies``; their names are free, but for those that begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.base import query, stage, table

#: Bytes of the content key.
KEY_BYTES = 16


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keepers(rows: DataFrame, by: list[str], keep: str) -> DataFrame:
    """``rows`` (``doc_id``, ``row`` and ``by``) with ``keep_id``, ``group_size``, ``kept`` of their groups."""
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    groups = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    met = rows.join(groups, [F.col(c) == F.col(f"__{c}") for c in by]).drop(*[f"__{c}" for c in by])
    met = stage(met.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    # More than one row with the id that stays: rows that repeat, or that have no id at all.
    first = met.filter("kept AND group_size > 1").groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(
        F.min("row").alias("__first"), F.count("*").alias("__n")
    ).filter("__n > 1")
    met = met.join(first, [F.col(c) == F.col(f"__{c}") for c in by], "left")
    only = F.col("kept") & (F.col("__first").isNull() | (F.col("row") == F.col("__first")))
    return met.withColumn("kept", only).drop("__first", "__n", *[f"__{c}" for c in by])


def mark_copies(
    docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] = lambda text: text, key_bytes: int = KEY_BYTES
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row: the id that stays in its group (``keep``: the
    smallest or the largest), the rows of the group, whether this row stays, and the digest of the normalised text."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text = normalise(F.coalesce("text", F.lit("")))
    named = docs.select("doc_id", text.alias("text")).withColumn("sha", _digest(F.col("text")))
    named = named.withColumn("key", F.substring("sha", 1, key_bytes))
    light = stage(named.select("doc_id", "sha", "key", F.monotonically_increasing_id().alias("row")))
    texts = named.groupBy("key", "text").agg(F.count("*").alias("n"))
    mixed = stage(texts.groupBy(F.col("key").alias("__k")).agg(F.count("*").alias("n")).filter("n > 1").select("__k"))
    parts = light
    if not mixed.isEmpty():
        parts = light.join(mixed, F.col("key") == F.col("__k"), "left_anti")
    out = _keepers(parts, ["key"], keep)
    if not mixed.isEmpty():
        apart = named.join(mixed, F.col("key") == F.col("__k"), "left_semi")
        apart = stage(apart.withColumn("row", F.monotonically_increasing_id()))
        out = out.unionByName(_keepers(apart, ["key", "text"], keep).drop("text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(
    docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] = lambda text: text
) -> DataFrame:
    """The rows that stay, in all their columns. Of rows equal in id and text that one stays whose other columns have
    the least hash (columns of maps, which have none, left out)."""
    marked = mark_copies(docs, keep, normalise)
    stays = marked.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    repeated = marked.groupBy(F.col("doc_id").alias("__i"), F.col("text_sha256").alias("__s")).agg(F.count("*").alias("__n"))
    stays = stage(stays.join(repeated, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__sha") == F.col("__s"))).drop("__i", "__s"))
    keyed = docs.withColumn("__text_sha", F.sha2(normalise(F.coalesce("text", F.lit(""))), 256))

    def met(some: DataFrame) -> DataFrame:
        return keyed.join(some, (F.col("__text_sha") == F.col("__sha")) & F.col("doc_id").eqNullSafe(F.col("__id")))

    once = met(stays.filter("__n = 1")).select(*docs.columns)
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and c not in ("doc_id", "text")]
    mark = F.xxhash64(F.lit(0), *hashed, *[F.col(c).isNull() for c in hashed])
    one = F.min_by(F.struct(*docs.columns), mark).alias("__one")
    return once.unionByName(met(stays.filter("__n > 1")).groupBy("__id", "__sha").agg(one).select("__one.*"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op13_exact_dedup", SQL)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"), keep="largest")
