"""Timers anchored on the row that starts them, over entities of any size.

An anchored chain walks the rows of one entity in order: the first row of an episode sets the
anchor, the first row at least ``gap`` seconds later fires, and the walk goes on from the firing
row (``restart="same"``) or from the row after it (``restart="next"``). Fixed windows, sliding
session gaps and division of elapsed time all give other answers, so the walk itself is kept, but
never over a whole entity in one task:

* only the first row of a second can fire, and of the others it only matters whether there are
  any, so an aggregate by second bounds an entity by its time span and not by its rows;
* an episode shorter than ``gap`` cannot fire and is dropped;
* the rest is cut into time chunks. Each chunk is summarised as a map from the incoming anchor to
  the outgoing one, the maps are composed per entity, and every chunk is walked once more with its
  true incoming anchor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import lineage

CHUNK_SECS_BITS = 20


def chain(
    df: DataFrame, entity: str, episode: str, order: str, ts: str, gap: int, *,
    restart: str = "same", chunk_bits: int = CHUNK_SECS_BITS,
) -> DataFrame:
    """Firing rows of every episode: ``entity, episode, order, ts, n, elapsed``.

    ``n`` counts firings within the episode, ``elapsed`` is the time since the anchor. ``ts`` are
    whole seconds and do not fall within an episode; ``episode`` is a long that rises with time.
    """
    if restart not in ("same", "next"):
        raise ValueError(f"unknown restart: {restart}")
    again = restart == "next"
    seconds = lineage.cut(
        df.groupBy(F.col(entity), F.col(episode).cast("long").alias(episode),
                   F.col(ts).cast("long").alias(ts))
        .agg(F.min(F.col(order).cast("long")).alias(order), (F.count("*") > 1).alias("more"))
    )
    span = seconds.groupBy(entity, episode).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    long_enough = span.filter(F.col("__b") - F.col("__a") >= gap).select(entity, episode)
    chunked = seconds.join(long_enough, [entity, episode], "left_semi").withColumn(
        "__chunk", F.shiftright(ts, chunk_bits))

    key_type = df.schema[entity].dataType.simpleString()
    map_schema = (
        f"`{entity}` {key_type}, __chunk long, ep_first long, ep_last long, one_ep boolean, "
        "entry_ts array<long>, exit_anchor array<long>, exit_n array<long>, "
        "own_anchor long, own_n long"
    )
    in_schema = f"`{entity}` {key_type}, __chunk long, in_ep long, in_anchor long, in_n long"
    out_schema = f"`{entity}` {key_type}, `{episode}` long, `{order}` long, `{ts}` long, n long, elapsed long"

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([episode, order])
        eps, times = pdf[episode].to_numpy(), pdf[ts].to_numpy()
        more = pdf["more"].to_numpy() & again
        first, last = int(eps[0]), int(eps[-1])
        head, head_more = times[eps == first], more[eps == first]
        tail, tail_more = times[eps == last], more[eps == last]
        # The incoming anchor is older than the chunk, so it fires at one of the rows of the first
        # ``gap`` seconds or not at all.
        reach = int(np.searchsorted(head, head[0] + gap, "left")) + 1
        entries = [int(t) for t in head[:reach]]
        exits = [_walk(head, head_more, i, gap, again) for i in range(len(entries))]
        own = _walk_fresh(tail, tail_more, gap, again)
        return pd.DataFrame({
            entity: [pdf[entity].iloc[0]], "__chunk": [int(pdf["__chunk"].iloc[0])],
            "ep_first": [first], "ep_last": [last], "one_ep": [first == last],
            "entry_ts": [entries], "exit_anchor": [[e[0] for e in exits]],
            "exit_n": [[e[1] for e in exits]], "own_anchor": [own[0]], "own_n": [own[1]],
        })

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        state = (None, None, 0)
        rows_out = []
        for r in pdf.itertuples(index=False):
            ep, anchor, n = state
            rows_out.append((getattr(r, entity), r[1], ep, anchor, n))
            if not r.one_ep or ep != r.ep_first:
                state = (r.ep_last, r.own_anchor if r.own_anchor >= 0 else None, r.own_n)
                continue
            if anchor is None:
                state = (ep, r.own_anchor if r.own_anchor >= 0 else None, n + r.own_n)
                continue
            i = int(np.searchsorted(np.asarray(r.entry_ts), anchor + gap, "left"))
            if i < len(r.entry_ts):
                out = r.exit_anchor[i]
                state = (ep, out if out >= 0 else None, n + r.exit_n[i])
        return pd.DataFrame(rows_out, columns=[entity, "__chunk", "in_ep", "in_anchor", "in_n"]).astype(
            {"in_ep": "Int64", "in_anchor": "Int64"}
        )

    def replay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values([episode, order])
        fired = []
        ep = anchor = None
        n = 0
        if len(right):
            r = right.iloc[0]
            ep = None if pd.isna(r["in_ep"]) else int(r["in_ep"])
            anchor = None if pd.isna(r["in_anchor"]) else int(r["in_anchor"])
            n = int(r["in_n"])
        cols = [left[c].tolist() for c in (episode, order, ts, "more")]
        for e, o, t, more in zip(*cols, strict=True):
            if e != ep:
                ep, anchor, n = e, t, 0
            elif anchor is None:
                anchor = t
            elif t - anchor >= gap:
                n += 1
                fired.append((e, o, t, n, t - anchor))
                anchor = t if more or not again else None
        out = pd.DataFrame(fired, columns=[episode, order, ts, "n", "elapsed"], dtype="int64")
        out.insert(0, entity, left[entity].iloc[0] if len(left) else None)
        return out

    maps = chunked.groupBy(entity, "__chunk").applyInPandas(summarise, map_schema)
    entry = maps.groupBy(entity).applyInPandas(compose, in_schema)
    return (
        chunked.groupBy(entity, "__chunk")
        .cogroup(entry.groupBy(entity, "__chunk"))
        .applyInPandas(replay, out_schema)
    )


def _walk(
    times: np.ndarray, more: np.ndarray, fire: int, gap: int, again: bool
) -> tuple[int, int]:
    """Outgoing (anchor, firings) when second ``fire`` is the first to fire; anchor -1 is unset.

    The next anchor is the firing second itself, or with ``again`` the next row, which lies in the
    same second when that holds ``more`` rows."""
    n = 1
    at = fire + 1 if again and not more[fire] else fire
    while at < len(times):
        nxt = int(np.searchsorted(times, times[at] + gap, "left"))
        if nxt >= len(times):
            return int(times[at]), n
        n += 1
        at = nxt + 1 if again and not more[nxt] else nxt
    return -1, n


def _walk_fresh(times: np.ndarray, more: np.ndarray, gap: int, again: bool) -> tuple[int, int]:
    """Outgoing (anchor, firings) when the first second sets the anchor."""
    nxt = int(np.searchsorted(times, times[0] + gap, "left"))
    if nxt >= len(times):
        return int(times[0]), 0
    return _walk(times, more, nxt, gap, again)
