"""Top-N per group, interleaving, section caps with disclosure, budgets, tails and balancing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import ordered


def landed_per_home(df: DataFrame, limit: int = 6) -> DataFrame:
    """Newest ``limit`` landed rows per home with their rank: date descending, id descending, a
    missing date sorts as the empty string. The rank filter becomes a per-task group limit, so a
    huge home ships only ``limit`` rows per input partition."""
    newest = Window.partitionBy("home").orderBy(
        F.coalesce("date", F.lit("")).desc(), F.col("id").desc()
    )
    return df.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= limit)


def round_robin(df: DataFrame, limit: int, per_home: int | None = None) -> DataFrame:
    """First row of every home in home order, then the second of every home, up to ``limit``."""
    ranked = landed_per_home(df, min(limit, per_home) if per_home else limit)
    return ranked.orderBy("rn", "home").limit(limit)


def landed_all(df: DataFrame) -> DataFrame:
    """Every landed row, newest first over all homes (a range-partitioned sort)."""
    return df.orderBy(F.coalesce("date", F.lit("")).desc(), F.col("id").desc())


def cap_section(
    df: DataFrame, section: str, order: Sequence[Column | str], limit: int | None, reveal: str
) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows and a disclosure row ``showing n of m`` when rows are left out."""
    total = df.agg(F.count("*").alias("total")).withColumn("section", F.lit(section))
    if limit is None:
        return df.orderBy(*order), total.filter(F.lit(False)).select(
            "section", F.lit("").alias("surface"), F.lit(reveal).alias("reveal")
        )
    note = F.concat(F.lit(f"{section} showing {limit} of "), F.col("total").cast("string"))
    omitted = total.filter(F.col("total") > limit).select(
        "section", note.alias("surface"), F.lit(reveal).alias("reveal")
    )
    return df.orderBy(*order).limit(limit), omitted


def ready_listing(
    df: DataFrame, gated: Column, order: Sequence[str], limit: int
) -> tuple[DataFrame, DataFrame]:
    """All gated rows plus the first ``limit`` plain ones, and the counts of what was left out."""
    marked = df.withColumn("gated", F.coalesce(gated, F.lit(False)))
    plain = marked.filter(~F.col("gated")).orderBy(*order).limit(limit)
    shown = marked.filter("gated").unionByName(plain)
    plain_total = F.sum((~F.col("gated")).cast("long"))
    counts = marked.agg(
        F.coalesce(F.sum(F.col("gated").cast("long")), F.lit(0)).alias("gated_rows"),
        F.coalesce(F.least(plain_total, F.lit(limit)), F.lit(0)).alias("plain_shown"),
        F.coalesce(plain_total, F.lit(0)).alias("plain_total"),
    )
    return shown, counts


def fit_budget(
    df: DataFrame, keys: Sequence[str], order: str, size: str, total: int, *,
    reserve: int = 0, chunk_bits: int = ordered.CHUNK_BITS,
) -> DataFrame:
    """Greedy budget per group: take an item when it still fits, skip it and go on when not.

    The remaining budget never rises, so once an item of some size is skipped, every later item of
    that size is skipped too. Of each size ``s`` only the first ``budget // s`` items can therefore
    be taken: that leaves at most ``budget * (1 + ln budget)`` candidates per group, whatever the
    group's size. Only those are walked in order; sizes must be positive.
    """
    budget = total - reserve
    fits = df.filter(F.col(size) <= budget)
    quota = F.floor(F.lit(budget) / F.col(size))
    chunked = fits.withColumn("__chunk", F.shiftright(F.col(order).cast("long"), chunk_bits))
    near = Window.partitionBy(*keys, size, "__chunk").orderBy(order)
    far = Window.partitionBy(*keys, size).orderBy(order)
    candidates = (
        chunked.withColumn("__n", F.row_number().over(near))
        .filter(F.col("__n") <= quota)
        .withColumn("__n", F.row_number().over(far))
        .filter(F.col("__n") <= quota)
        .drop("__n", "__chunk")
    )
    gathered = candidates.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("items")
    )
    start = F.struct(
        F.lit(0).cast("long").alias("used"),
        F.array().cast("array<bigint>").alias("taken"),
    )

    def step(acc: Column, item: Column) -> Column:
        ok = acc["used"] + item["s"] <= budget
        return F.struct(
            F.when(ok, acc["used"] + item["s"]).otherwise(acc["used"]).alias("used"),
            F.when(ok, F.array_append(acc["taken"], item["o"])).otherwise(acc["taken"]).alias("taken"),
        )

    walked = gathered.select(*keys, F.aggregate("items", start, step)["taken"].alias("__taken"))
    taken = walked.select(*keys, F.explode("__taken").alias(order))
    return df.join(taken, [*keys, order], "left_semi")


def omitted(df: DataFrame, shown: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group, how many of its rows are ``shown`` and how many are ``omitted``. One map-side-combined aggregate over
    both; a group that shows nothing has its row as well."""
    marked = df.select(*keys, F.lit(0).alias("__shown")).unionByName(shown.select(*keys, F.lit(1).alias("__shown")))
    counts = marked.groupBy(*keys).agg(F.sum("__shown").alias("shown"), F.count("*").alias("__all"))
    return counts.select(*keys, "shown", (F.col("__all") - 2 * F.col("shown")).alias("omitted"))


def bounded_tail(
    df: DataFrame, keys: Sequence[str], order: str, line: str, max_lines: int, max_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """Last ``max_lines`` lines within the last ``max_bytes`` bytes of each log, newline included;
    a line cut by the byte limit is dropped. Also returns one row per log with the reasons."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    upto = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = (F.octet_length(line) + 1).cast("long")
    totals = df.groupBy(*keys).agg(F.count("*").alias("lines"), F.sum(size).alias("bytes"))
    # One line more than asked tells whether the line limit cut anything.
    last_lines = (
        df.withColumn("__rn", F.row_number().over(newest))
        .filter(F.col("__rn") <= max_lines + 1)
        .withColumn("__from_end", F.sum(size).over(upto))
        .join(totals.select(*keys, "bytes"), list(keys))
        # Past the byte limit the first kept line needs the newline before it inside the limit.
        .filter((F.col("bytes") <= max_bytes) | (F.col("__from_end") < max_bytes))
    )
    kept = last_lines.filter(F.col("__rn") <= max_lines).select(*df.columns)
    cut = last_lines.groupBy(*keys).agg((F.max("__rn") > max_lines).alias("line_limit"))
    reasons = totals.join(cut, list(keys), "left").select(
        *keys, "lines", "bytes",
        (F.col("bytes") > max_bytes).alias("byte_limit"),
        F.coalesce("line_limit", F.lit(False)).alias("line_limit"),
    )
    return kept, reasons


def lpt_assign(
    df: DataFrame, group: Sequence[str], name: str, weight: str, bins: int, default: int
) -> DataFrame:
    """Longest-processing-time assignment to ``bins`` per group: heaviest first, ties by name, each
    item to the least loaded bin, the lowest bin winning ties. Unknown weights take ``default``.

    Items of equal weight are interchangeable for the loads, so a group is walked as runs of
    (weight, count); its rows are never gathered. A run needs the loads before it and each item's
    rank in it, and the rank is a window over one weight of one group.
    """
    items = df.withColumn("__w", F.coalesce(F.col(weight), F.lit(default)).cast("long"))
    runs = items.groupBy(*group, "__w").agg(F.count("*").alias("__n"))
    names = list(group)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group).schema]
    schema = ", ".join([*fields, "__w long", "loads array<long>"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__w", ascending=False)
        loads = np.zeros(bins, dtype=np.int64)
        before = []
        for w, n in zip(pdf["__w"].to_numpy(), pdf["__n"].to_numpy(), strict=True):
            before.append(loads.tolist())
            loads = loads + w * _slots_per_bin(loads, int(w), int(n))
        return pdf[[*names, "__w"]].assign(loads=before)

    before = runs.groupBy(*group).applyInPandas(walk, schema)
    ranked = _rank_by_name(items, [*group, "__w"], name).join(before, [*group, "__w"])
    shard = F.pandas_udf(_slot_bin, "long")
    return ranked.select(
        *group, F.col(name), F.col("__w").alias("weight"),
        (shard(F.col("loads"), F.col("__w"), F.col("__r")) + 1).alias("bin"),
    )


def _rank_by_name(df: DataFrame, keys: Sequence[str], name: str, chars: int = 3) -> DataFrame:
    """0-based rank by name within a key. The names of a key are split by the characters after
    their common prefix (that of the least and the greatest name), so a heavy key is ranked in
    many tasks; the sizes of the earlier splits are added."""
    ends = df.groupBy(*keys).agg(F.min(name).alias("__lo"), F.max(name).alias("__hi"))
    same = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length("__lo"), F.lit(1))),
        lambda i: F.substring(F.col("__lo"), F.lit(1), i) == F.substring(F.col("__hi"), F.lit(1), i),
    )
    src = df.join(ends.select(*keys, F.size(same).alias("__skip")), list(keys)).withColumn(
        "__p", F.substring(F.col(name), F.lit(1), F.col("__skip") + chars)
    )
    sizes = src.groupBy(*keys, "__p").agg(F.count("*").alias("__c"))
    earlier = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(*keys, "__p", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__o"))
    near = Window.partitionBy(*keys, "__p").orderBy(name)
    return (
        src.withColumn("__r", F.row_number().over(near) - 1)
        .join(offset, [*keys, "__p"])
        .withColumn("__r", (F.col("__r") + F.col("__o")).cast("long"))
        .drop("__p", "__o", "__skip")
    )


SMALL_RUN = 32


def _take_turns(loads: np.ndarray, w: int, n: int) -> list[int]:
    """Bins of ``n`` items of one weight, in order."""
    now = loads.tolist()
    order = []
    for _ in range(n):
        best = now.index(min(now))
        now[best] += w
        order.append(best)
    return order


def _slots_per_bin(loads: np.ndarray, w: int, n: int) -> np.ndarray:
    """How many of ``n`` items of weight ``w`` each bin takes, starting from ``loads``."""
    if w == 0:
        out = np.zeros(len(loads), dtype=np.int64)
        out[int(np.argmin(loads))] = n
        return out
    if n <= SMALL_RUN:
        out = np.zeros(len(loads), dtype=np.int64)
        np.add.at(out, _take_turns(loads, w, n), 1)
        return out
    # Slot i of bin j starts at loads[j] + i * w; the n smallest (start, bin) pairs are taken.
    low, high = int(loads.min()), int(loads.min()) + w * n
    while low < high:
        level = (low + high) // 2
        if int(np.maximum((level - loads) // w + 1, 0).sum()) >= n:
            high = level
        else:
            low = level + 1
    below = np.maximum((low - 1 - loads) // w + 1, 0)
    rest = n - int(below.sum())
    at_level = np.flatnonzero((loads <= low) & ((low - loads) % w == 0))
    below[at_level[:rest]] += 1
    return below


def _slot_bin(loads: pd.Series, weight: pd.Series, rank: pd.Series) -> pd.Series:
    """Bin of the item with 0-based ``rank`` in its run."""
    runs: dict[tuple, tuple[np.ndarray, int, np.ndarray]] = {}
    out = np.empty(len(rank), dtype=np.int64)
    for i, (before, w, r) in enumerate(zip(loads, weight, rank, strict=True)):
        key = (*before, w)
        if key not in runs:
            arr = np.asarray(before, dtype=np.int64)
            # After ``level`` items every load lies within one weight of the highest: from then on
            # the bins take turns in the order of their loads.
            gaps = -((arr - arr.max()) // max(int(w), 1))
            order = np.argsort(arr + gaps * int(w), kind="stable")
            runs[key] = (arr, int(gaps.sum()), order)
        arr, level, order = runs[key]
        if w == 0:
            out[i] = int(np.argmin(arr))
        elif r >= level:
            out[i] = order[(int(r) - level) % len(order)]
        elif r < SMALL_RUN:
            out[i] = _take_turns(arr, int(w), int(r) + 1)[-1]
        else:
            gained = _slots_per_bin(arr, int(w), int(r) + 1) - _slots_per_bin(arr, int(w), int(r))
            out[i] = int(np.flatnonzero(gained)[0])
    return pd.Series(out)


def quota_choice(requests: DataFrame, quota: DataFrame, windows: DataFrame, margin: int = 20) -> DataFrame:
    """Best candidate per request. A candidate's score is the lowest remaining share over its
    general windows; the best fresh one wins unless a stale one leads by ``margin``; ties go to the
    candidate listed first; with no usable candidate the first listed is the fallback.

    ``requests``: ``request, idx, vendor``; ``quota``: ``vendor, status, window_id, kind,
    remaining`` (null when not a number); ``windows``: general ``vendor, window_id``.
    """
    usable = quota.join(windows.select("vendor", "window_id").distinct(), ["vendor", "window_id"], "left_semi")
    usable = usable.filter((F.coalesce("kind", F.lit("")) != "model") & F.col("remaining").isNotNull())
    scores = usable.groupBy("vendor").agg(
        F.min("remaining").alias("score"),
        F.max((F.col("status") == "fresh").cast("int")).alias("fresh"),
    )
    scored = requests.join(scores, "vendor", "left")
    rank = F.struct(F.col("score"), (-F.col("idx")).alias("place"))
    fresh, stale = F.col("fresh") == 1, F.col("fresh") == 0
    best = scored.groupBy("request").agg(
        F.max(F.when(fresh, rank)).alias("f"),
        F.max(F.when(stale, rank)).alias("s"),
        F.min("idx").alias("first_idx"),
    )
    stale_wins = F.col("f").isNull() | (F.col("s.score") >= F.col("f.score") + margin)
    idx = F.when(F.col("s").isNotNull() & stale_wins, -F.col("s.place")).when(
        F.col("f").isNotNull(), -F.col("f.place")
    )
    chosen = best.select(
        "request",
        F.coalesce(idx, F.col("first_idx")).alias("idx"),
        idx.isNull().alias("fallback"),
    )
    return chosen.join(requests, ["request", "idx"]).select("request", "idx", "vendor", "fallback")
