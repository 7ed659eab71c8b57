"""Runner for rules that carry state and timers per key, on event time.

Rows of one key are replayed in order of (time, position); due timers fire before the row that
passes them, and on the watermark when no row comes. Without a delay rows are taken as they come, and
the result does not depend on how the input falls into micro-batches as long as a key's rows come in
order. With a delay a row waits in its key's state until the newest row of the stream is that far
ahead, so rows that come in any order within the delay give the result of ordered ones; the last rows
wait for newer ones. Rows before what the key has already seen, or before a timer it has fired, come
out as ``late``; the watermark fires timers and frees waiting rows, and drops none. A rule that keeps no
state for a key forgets its place. A key's rows of one trigger are sorted in one task, as columns of which
a stretch at a time becomes rows, so the source's per-trigger limit (``maxFilesPerTrigger`` or
``maxBytesPerTrigger``) and the delay bound it.

Calling Python once a key costs about as much as a thousand rows. With ``buckets`` the states of all keys of a
hash bucket are one state, and a trigger reads and rewrites the buckets of its keys: for streams of very many
keys with few rows each. Their number is for the life of the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The key under which Spark marks the watermark column, and the last time that pandas holds (year 2262).
_MARK = "spark.watermarkDelayMs"
_NEVER = 9_223_372_000
#: Rows that are Python objects at a time, and different strings of a column of which one copy is kept.
_STRETCH, _POOL = 4096, 1024

Row = dict[str, Any]
State = dict[str, Any]


class Rule(Protocol):
    """One rule: fresh state, effect of a row, next timer and its effect, and whether a state is
    worth keeping. All times in seconds."""

    columns: tuple[str, ...]
    output: str

    def fresh(self) -> State: ...

    def on_row(self, state: State, row: Row) -> list[tuple]: ...

    def due(self, state: State) -> int | None: ...

    def on_timer(self, state: State, at: int) -> list[tuple]: ...

    def keep(self, state: State) -> bool: ...


def replay(rule: Rule, state: State, rows: Iterable[Row], until: int) -> list[tuple]:
    """Feed ordered rows, then the timers due by ``until``. Also the batch form of every rule."""
    return list(played(rule, state, rows, until))


def played(rule: Rule, state: State, rows: Iterable[Row], until: int) -> Iterator[tuple]:
    """What :func:`replay` gives, one by one; the state is the one after it at the end."""
    # Rules that take rows in any order judge by themselves what they can no longer know.
    state["until"], any_order = until, getattr(rule, "any_order", False)

    def timers(limit: int) -> Iterator[tuple]:
        while (due := rule.due(state)) is not None and due <= limit:
            state["fired"] = due
            yield from rule.on_timer(state, due)

    for row in rows:
        place = [row["ts"], row["seq"]]
        if not any_order and (place < state.get("seen", [-1, -1]) or row["ts"] < state.get("fired", -1)):
            yield ("late", row["ts"], row["seq"], *[None] * (len(_fields(rule.output)) - 3))
            continue
        if not any_order:
            yield from timers(row["ts"])
        state["seen"] = place
        yield from rule.on_row(state, row)
    yield from timers(until)


def _fields(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def _plain(values: pd.Series, pool: dict[str, str]) -> np.ndarray:
    """Values of a column with nulls as None; of a string that repeats one copy."""
    if values.dtype.kind in "biu":
        return values.to_numpy()
    out = np.empty(len(values), object)
    for i, v in enumerate(values.tolist()):
        if isinstance(v, str):
            v = pool.setdefault(v, v) if len(pool) < _POOL else pool.get(v, v)
        out[i] = None if v is None or v != v else v
    return out


class _Rows:
    """Rows of one key, or of a bucket of keys, as columns: a few bytes a row instead of an object."""

    def __init__(self, batches: Iterator[pd.DataFrame], columns: list[str]) -> None:
        pools: list[dict[str, str]] = [{} for _ in columns]
        parts = [[_plain(batch[c], pool) for c, pool in zip(columns, pools, strict=True)] for batch in batches]
        self.columns = columns
        self.values = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * len(columns)

    def order(self) -> np.ndarray:
        """Places of the rows by ``ts`` and ``seq``."""
        ts, seq = (self.values[self.columns.index(c)] for c in ("ts", "seq"))
        if ts.dtype != object and seq.dtype != object:
            return np.lexsort((seq, ts))
        return np.array(sorted(range(len(ts)), key=lambda i: (ts[i], seq[i])), np.int64)

    def rows(self, places: np.ndarray) -> Iterator[Row]:
        for at in range(0, len(places), _STRETCH):
            some = places[at : at + _STRETCH]
            for row in zip(*[v[some].tolist() for v in self.values], strict=True):
                yield dict(zip(self.columns, row, strict=True))


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, _STRETCH)):
        yield pd.DataFrame(some, columns=columns)


def stream(
    df: DataFrame, key: str, rule: Rule, delay: str | None = None, hold: bool = True, buckets: int | None = None,
) -> DataFrame:
    """Run ``rule`` over a stream with the key column, ``ts`` (epoch seconds), ``seq`` and the
    rule's columns. Output: the key and the rule's columns, ``kind, ts, seq`` first. With ``hold`` rows
    wait for ``delay``; without it the delay only holds back the timers that no row of the key fires.
    With ``buckets`` the states of a bucket's keys are kept together, by the keys as strings."""
    hold = hold and delay is not None
    key_type = df.schema[key].dataType.simpleString()
    names = _fields(rule.output)
    wanted = ["ts", "seq", *rule.columns]
    timed = df.select(key, "ts", "seq", *rule.columns).withColumn(
        "event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay or "0 seconds")
    # Spark drops rows whose marked column is behind the watermark. The clock has been read above
    # this point, so the mark moves to a column that never is.
    mark = timed.schema["event_time"].metadata
    never = F.timestamp_seconds(F.lit(_NEVER)).alias("event_time", metadata=mark or {_MARK: 0})
    timed = timed.select(key, "ts", "seq", *rule.columns, never)

    def play(state: State, rows: Iterable[Row], mark: int) -> Iterator[tuple]:
        """Rows of one key and its timers; what has to wait is kept in the state."""
        until = mark // 1000 if mark > 0 else -1
        if not hold:
            yield from played(rule, state, rows, until)
            return
        ready = sorted([*state.pop("held", []), *rows], key=lambda r: (r["ts"], r["seq"]))
        # Rows of the very second that the watermark has reached may still come.
        waiting = [r for r in ready if r["ts"] >= until]
        yield from played(rule, state, ready[: len(ready) - len(waiting)], until - 1)
        if waiting:
            state["held"] = waiting

    def wake(state: State, mark: int) -> int | None:
        """When a key that gets no row has to be looked at."""
        waiting = state.get("held")
        due = [t for t in (rule.due(state), waiting[0]["ts"] if waiting else None) if t is not None]
        return max((min(due) + hold) * 1000, mark + 1) if due else None

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else rule.fresh()
        mark = held.getCurrentWatermarkMs()
        came = _Rows(iter(()) if held.hasTimedOut else batches, wanted)
        yield from _frames(((k[0], *o) for o in play(state, came.rows(came.order()), mark)), [key, *names])
        if state.get("held") or rule.keep(state):
            held.update((json.dumps(state),))
            if (at := wake(state, mark)) is not None:
                held.setTimeoutTimestamp(at)
        elif held.exists:
            held.remove()

    def step_bucket(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        mark = held.getCurrentWatermarkMs()
        # State and time to wake of each key.
        states = {name: (state, at) for name, state, at in json.loads(held.get[0])} if held.exists else {}
        came = _Rows(iter(()) if held.hasTimedOut else batches, [key, *wanted])
        touched: dict[Any, list[int]] = {}
        order = came.order()
        for place, name in zip(order.tolist(), came.values[0][order].tolist(), strict=True):
            touched.setdefault(name, []).append(place)
        for name, (_, at) in states.items():
            if at is not None and at < mark:
                touched.setdefault(name, [])

        def run() -> Iterator[tuple]:
            for name, places in touched.items():
                state = states[name][0] if name in states else rule.fresh()
                for o in play(state, came.rows(np.array(places, np.int64)), mark):
                    yield (name, *o)
                if state.get("held") or rule.keep(state):
                    states[name] = (state, wake(state, mark))
                else:
                    states.pop(name, None)

        yield from _frames(run(), [key, *names])
        if states:
            held.update((json.dumps([(name, *s) for name, s in states.items()]),))
            if due := [at for _, at in states.values() if at is not None]:
                held.setTimeoutTimestamp(max(min(due), mark + 1))
        elif held.exists:
            held.remove()

    if buckets is None:
        return timed.groupBy(key).applyInPandasWithState(
            step, f"{key} {key_type}, {rule.output}", "blob string", "append", GroupStateTimeout.EventTimeTimeout)
    named = timed.withColumn(key, F.col(key).cast("string"))
    placed = named.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    out = placed.groupBy("__bucket").applyInPandasWithState(
        step_bucket, f"{key} string, {rule.output}", "blob string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn(key, F.col(key).cast(key_type))
