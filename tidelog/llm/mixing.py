"""Mixing sources to target weights by entropy balancing.

Targets: the corpus size is shared by weight; a source takes at most ``cap`` times its size, and what is above that is
shared anew among the others. Rates: of all rates with the wanted token totals, entropy balancing takes those closest
to the corpus in relative entropy, counted per token. Their form is ``exp(sum of multipliers)``, one multiplier per
margin value, found by Newton steps on the convex dual; each step is a distributed aggregate over the cells of the
margins. Copies: rates become whole copies by systematic rounding down the sizes of a source, and the rest is made
good on the size that fits it best.

Nulls and odd cases: null text has size 0; a null source is a source of its own, ranked last; rows without id are
documents like others; repeated rows are mixed one by one; sources without words get target 0; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.base import global_rank, query, stage, table, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
TOLERANCE = 1e-10
MAX_STEPS = 100
ADJUST_ROUNDS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, n_docs, source_size, weight, target`` of every source."""
    sources = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = stage(ranked.withColumn("weight", weight.cast("long")).drop("rank"))
    limit = F.col("source_size") * cap
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full, before = 0.0, F.lit(False), None
    # Each round fills more sources; the numbers are whole, so every rerun takes the same rounds.
    while True:
        row = ranked.agg(
            F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))),
            F.sum(full.cast("long")),
        ).first()
        if row[2] == before or not row[1]:
            break
        level, before = (total - row[0]) / row[1], row[2]
        full = F.col("weight") * F.lit(level) >= limit
    target = F.when(full, limit.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target)


def balance(cells: DataFrame, margins: dict[str, DataFrame]) -> DataFrame:
    """Add ``rate`` to cells of ``tokens``. ``margins`` gives, for a column of the cells, a table of that column and
    ``target``. Newton steps on the dual, margin by margin: the block of one margin's Hessian is diagonal (its cells'
    current tokens), so a step is ``(target - tokens) / tokens``, kept within 1 where the start is far off."""
    state = cells.withColumn("__log_rate", F.lit(0.0))
    for _ in range(MAX_STEPS):
        worst = []
        for column, targets in margins.items():
            now = state.groupBy(column).agg(F.sum(F.col("tokens") * F.exp("__log_rate")).alias("__now"))
            t = targets.select(F.col(column).alias("__key"), F.col("target").alias("__target"))
            steps = now.join(t, F.col(column).eqNullSafe(F.col("__key")), "left").select(
                F.col(column).alias("__key"),
                F.when((F.col("__now") > 0) & (F.col("__target") > 0), F.col("__target") / F.col("__now") - 1)
                .otherwise(0.0).alias("__gap"),
            )
            step = F.least(F.greatest(F.col("__gap"), F.lit(-1.0)), F.lit(1.0))
            state = (
                state.join(steps, F.col(column).eqNullSafe(F.col("__key")), "left")
                .withColumn("__log_rate", F.col("__log_rate") + F.coalesce(step, F.lit(0.0)))
                .withColumn("__error", F.abs(F.coalesce("__gap", F.lit(0.0))))
                .drop("__key", "__gap")
            )
            state = stage(state)
            worst.append(state.agg(F.max("__error")).first()[0] or 0.0)
            state = state.drop("__error")
        if max(worst) <= TOLERANCE:
            break
    rate = F.exp("__log_rate")
    for column, targets in margins.items():  # a target of 0 lies at minus infinity
        none = targets.filter(F.col("target") <= 0).select(F.col(column).alias("__key"), F.lit(True).alias("__none"))
        state = state.join(none, F.col(column).eqNullSafe(F.col("__key")), "left").drop("__key")
        rate = F.when(F.col("__none"), F.lit(0.0)).otherwise(rate)
        state = state.withColumn("rate", rate).drop("__none")
        rate = F.col("rate")
    return state.drop("__log_rate")


def whole_copies(bins: DataFrame, cap: int = CAP) -> DataFrame:
    """Add ``copies``, of all documents together, to bins of ``source, size, n_docs, rate, target``.

    Down the sizes of a source, the running sum of rates is rounded, so the error at any point is below one document.
    What is then missing or too much goes, where that helps, to a document of the size nearest to it."""
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    until = F.sum(F.col("n_docs") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    out = bins.withColumn("__until", F.floor(until + 0.5))
    out = out.withColumn("copies", F.col("__until") - F.coalesce(F.lag("__until").over(down), F.lit(0)))
    most = F.col("n_docs") * cap
    out = stage(out.withColumn("copies", F.greatest(F.least("copies", most), F.lit(0))).drop("__until"))
    for _ in range(ADJUST_ROUNDS):
        rest = out.groupBy("source").agg(
            (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("__rest")
        ).withColumnRenamed("source", "__key")
        met = out.join(rest, F.col("source").eqNullSafe(F.col("__key"))).drop("__key")
        gap = F.abs(F.abs("__rest") - F.col("size"))
        can = F.when(F.col("__rest") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        best = (
            met.filter(can & (gap < F.abs("__rest"))).groupBy("source")
            .agg(F.min(F.struct(gap.alias("gap"), F.col("size").alias("size"), F.signum("__rest").alias("sign"))).alias("b"))
            .select(F.col("source").alias("__key"), F.col("b.size").alias("__size"), F.col("b.sign").alias("__sign"))
        )
        out = stage(
            out.join(best, F.col("source").eqNullSafe(F.col("__key")) & (F.col("size") == F.col("__size")), "left")
            .withColumn("copies", F.col("copies") + F.coalesce(F.col("__sign").cast("long"), F.lit(0)))
            .drop("__key", "__size", "__sign")
        )
    return out


def mix(
    docs: DataFrame, size: Column, weights: Sequence[int] = WEIGHTS, cap: int = CAP, key: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every document, and the columns of ``key``, which also
    order documents of equal id."""
    sizes = stage(docs.select("doc_id", "source", size.cast("long").alias("size"), *key))
    targets = stage(source_targets(sizes, weights, cap))
    cells = targets.select("source", F.col("source_size").alias("tokens"))
    rates = balance(cells, {"source": targets}).select(F.col("source").alias("__key"), F.least("rate", F.lit(float(cap))).alias("rate"))
    known = targets.join(rates, F.col("source").eqNullSafe(F.col("__key"))).select(
        F.col("source").alias("__key"), "source_size", "target", "rate"
    )
    bins = sizes.groupBy("source", "size").agg(F.count("*").alias("n_docs"))
    bins = bins.join(known, F.col("source").eqNullSafe(F.col("__key"))).drop("__key")
    bins = whole_copies(bins, cap)
    # The documents of a bin are alike; its copies are dealt over them by their place in the total order.
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_last(), *map(F.col, key)]
    placed = global_rank(sizes, order, "__rank")
    starts = bins.select(
        F.col("source").alias("__source"), F.col("size").alias("__size"), "source_size", "target", "copies", "n_docs"
    )
    firsts = placed.groupBy("source", "size").agg(F.min("__rank").alias("__first")).select(
        F.col("source").alias("__s"), F.col("size").alias("__z"), "__first"
    )
    starts = starts.join(firsts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))).drop("__s", "__z")
    met = placed.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")))
    # Whole-number form of floor((place + 1) * k / n) - floor(place * k / n).
    own = F.expr("((__rank - __first + 1) * copies) div n_docs - ((__rank - __first) * copies) div n_docs")
    return met.select("doc_id", "source", "size", "source_size", "target", own.alias("copies"), *key)


@query("op4_mix_sources")
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, word_count(F.col("text"))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
