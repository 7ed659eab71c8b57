"""Rules with state and timers, as small step functions used by stream and batch alike."""

from __future__ import annotations

from dataclasses import dataclass

from tidelog.streaming.keyed import Row, State
from tidelog.vocab import DEFAULT_THRESHOLDS, Thresholds


class _Kept:
    def keep(self, state: State) -> bool:
        return True


class _NoTimer(_Kept):
    def due(self, state: State) -> int | None:
        return None

    def on_timer(self, state: State, at: int) -> list[tuple]:
        return []


@dataclass(frozen=True)
class CoalesceSignals(_Kept):
    """After the first change wait ``grace`` seconds, then emit the last write of every changed
    name. The window is anchored at its first row and does not slide."""

    grace: int = DEFAULT_THRESHOLDS.signal_grace
    columns: tuple[str, ...] = ("name", "content")
    output: str = "kind string, ts long, seq long, name string, content string"

    def fresh(self) -> State:
        return {"first": None, "files": {}}

    def on_row(self, state: State, row: Row) -> list[tuple]:
        if state["first"] is None:
            state["first"] = row["ts"]
        state["files"][row["name"]] = [row["seq"], row["content"]]
        return []

    def due(self, state: State) -> int | None:
        return None if state["first"] is None else state["first"] + self.grace

    def on_timer(self, state: State, at: int) -> list[tuple]:
        out = [("signal", at, seq, name, content) for name, (seq, content) in sorted(state["files"].items())]
        state.update(self.fresh())
        return out


@dataclass(frozen=True)
class BatchEscalations(_Kept):
    """Flush the buffer as one digest when its oldest item is ``batch`` seconds old. While the sink
    is down (rows of kind ``down``/``up``) the buffer stays, and an alarm comes when the oldest is
    ``max_defer`` seconds old, then once per further window."""

    batch: int = DEFAULT_THRESHOLDS.batch_secs
    max_defer: int = DEFAULT_THRESHOLDS.max_defer
    columns: tuple[str, ...] = ("kind", "item")
    output: str = "kind string, ts long, seq long, opened_at long, items long, digest string"

    def fresh(self) -> State:
        return {"since": None, "items": [], "down": False, "alarm": None}

    def on_row(self, state: State, row: Row) -> list[tuple]:
        if row["kind"] == "item":
            if state["since"] is None:
                state["since"] = row["ts"]
                state["alarm"] = row["ts"] + self.max_defer
            state["items"].append([row["seq"], row["item"]])
            return []
        state["down"] = row["kind"] == "down"
        late = state["since"] is not None and row["ts"] >= state["since"] + self.batch
        return self._flush(state, row["ts"]) if late and not state["down"] else []

    def _flush(self, state: State, at: int) -> list[tuple]:
        items = state["items"]
        text = " | ".join(i for _, i in items)
        out = [("digest", at, items[-1][0], state["since"], len(items), text)]
        state.update(since=None, items=[], alarm=None)
        return out

    def due(self, state: State) -> int | None:
        if state["since"] is None:
            return None
        return state["alarm"] if state["down"] else state["since"] + self.batch

    def on_timer(self, state: State, at: int) -> list[tuple]:
        if not state["down"]:
            return self._flush(state, at)
        state["alarm"] += self.max_defer
        return [("alarm", at, state["items"][-1][0], state["since"], len(state["items"]), None)]


@dataclass(frozen=True)
class Timers(_Kept):
    """Staleness, pause and stall timers of one entity over ``poll``, ``check`` and ``log`` rows."""

    limits: Thresholds = DEFAULT_THRESHOLDS
    columns: tuple[str, ...] = ("kind", "hash", "busy", "phase", "token", "agent", "verb")
    output: str = "kind string, ts long, seq long, n long, elapsed long, demand boolean"
    paused: str = "paused"

    def fresh(self) -> State:
        return {"hash": None, "repeats": 0, "since": None, "n": 0, "token": None, "stamp": None,
                "pause": None, "ticks": 0}

    def on_row(self, state: State, row: Row) -> list[tuple]:
        return getattr(self, f"_{row['kind']}")(state, row)

    def _poll(self, s: State, row: Row) -> list[tuple]:
        same = s["hash"] is not None and s["hash"] == row["hash"]
        s["repeats"] = s["repeats"] + 1 if same else 0
        s["hash"] = row["hash"]
        if s["repeats"] < 2 or row["busy"]:
            s.update(since=None, n=0)
            return []
        if s["since"] is None:
            s["since"] = row["ts"]
            return []
        idle = row["ts"] - s["since"]
        if idle < self.limits.stale_escalate:
            return []
        s.update(since=None, n=s["n"] + 1)
        demand = s["n"] >= self.limits.demand_inspect_count
        return [("wedge", row["ts"], row["seq"], s["n"], idle, demand)]

    def _check(self, s: State, row: Row) -> list[tuple]:
        dead = row["agent"] == "dead" and row["phase"] != "done"
        if row["phase"] not in ("working", "done") or dead or row["token"] is None:
            return []
        if s["stamp"] is None or s["token"] != row["token"]:
            s.update(token=row["token"], stamp=row["ts"])
            return []
        age = row["ts"] - s["stamp"]
        if age < self.limits.progress_ceiling:
            return []
        s["stamp"] = row["ts"]
        return [("stall", row["ts"], row["seq"], 1, age, False)]

    def _log(self, s: State, row: Row) -> list[tuple]:
        s.update(pause=row["ts"] if row["verb"] == self.paused else None, ticks=0)
        return []

    def due(self, state: State) -> int | None:
        if state["pause"] is None:
            return None
        return state["pause"] + (state["ticks"] + 1) * self.limits.pause_resurface

    def on_timer(self, state: State, at: int) -> list[tuple]:
        state["ticks"] += 1
        return [("pause", at, state["seen"][1], state["ticks"], at - state["pause"], False)]


@dataclass(frozen=True)
class AlertEdges(_NoTimer):
    """``rising``: threshold hysteresis on ``over``; ``text``: failing text unlike the last one
    fired; ``edge``: one ``blocked`` until a ``working``."""

    mode: str = "rising"
    columns: tuple[str, ...] = ("over", "failed", "text", "to_status")
    output: str = "kind string, ts long, seq long, text string"

    def fresh(self) -> State:
        return {"mark": None}

    def on_row(self, state: State, row: Row) -> list[tuple]:
        if self.mode == "rising":
            active, mark = bool(row["over"]), "over"
        elif self.mode == "text":
            if not row["text"]:
                return []
            active, mark = bool(row["failed"]), row["text"]
        else:
            if row["to_status"] not in ("blocked", "working"):
                return []
            active, mark = row["to_status"] == "blocked", "blocked"
        fires = active and state["mark"] != mark
        state["mark"] = mark if active else None
        return [(self.mode, row["ts"], row["seq"], row["text"])] if fires else []


@dataclass(frozen=True)
class BusyState(_NoTimer):
    """Accept an event of the armed incarnation with a rising sequence; anything else is ``stale``.
    Rows of kind ``arm`` start a new incarnation."""

    columns: tuple[str, ...] = ("kind", "gen", "gen_seq", "state")
    output: str = "kind string, ts long, seq long, gen string, gen_seq long, state string"

    def fresh(self) -> State:
        return {"gen": None, "gen_seq": -1, "state": "unknown"}

    def on_row(self, state: State, row: Row) -> list[tuple]:
        if row["kind"] == "arm":
            state.update(gen=row["gen"], gen_seq=-1, state="busy")
            return [("armed", row["ts"], row["seq"], row["gen"], 0, "busy")]
        fresh = row["gen"] == state["gen"] and row["gen_seq"] > state["gen_seq"]
        if fresh:
            state.update(gen_seq=row["gen_seq"], state=row["state"])
        kind = "accepted" if fresh else "stale"
        return [(kind, row["ts"], row["seq"], row["gen"], row["gen_seq"], row["state"])]


@dataclass(frozen=True)
class Replies:
    """Request-reply ledger of one correlation id.

    Rows: ``request`` (delivered), ``busy``/``idle`` (activity), ``outcome`` of the recovery send
    (``confirmed``, ``failed``, ``unknown`` in ``text``) and ``report``. A report resolves at any
    time; once the turn completed and ``grace`` passed, one recovery goes out; a missed or failed
    recovery escalates once; a late report closes the escalation. Nothing expires. A report that comes
    before its request waits ``wait`` seconds for it and resolves it as it opens; without one it comes out
    as ``unmatched``, with the number of such reports. Sends and escalations are output rows, not side
    effects."""

    grace: int = DEFAULT_THRESHOLDS.reply_grace
    wait: int = DEFAULT_THRESHOLDS.early_reply_wait
    columns: tuple[str, ...] = ("kind", "text")
    output: str = "kind string, ts long, seq long, phase string, detail string"

    def keep(self, state: State) -> bool:
        """A request stays until the end of time, a report without one until its deadline. Other rows of tokens that
        nobody asked for leave nothing behind."""
        return state["phase"] is not None or state["early"] is not None

    def fresh(self) -> State:
        return {"phase": None, "delivered": None, "completed": None, "escalated": False, "early": None}

    def _to(self, state: State, kind: str, row: Row, phase: str, detail: str | None) -> tuple:
        state["phase"] = phase
        return (kind, row["ts"], row["seq"], phase, detail)

    def on_row(self, state: State, row: Row) -> list[tuple]:
        kind, phase = row["kind"], state["phase"]
        if kind == "request":
            if phase is not None:
                return []
            state["delivered"], early = row["ts"], state["early"]
            out = [self._to(state, "opened", row, "awaiting_report", None)]
            if early is not None:
                state["early"] = None
                out.append(self._to(state, "resolved", {"ts": row["ts"], "seq": early["seq"]}, "resolved", early["text"]))
            return out
        if phase is None and kind == "report":
            # The first one is what a request will be resolved by; of further ones the number is kept.
            early = state["early"] or {"ts": row["ts"], "seq": row["seq"], "text": row["text"], "n": 0}
            state["early"] = early | {"n": early["n"] + 1}
            return []
        if phase in (None, "resolved"):
            return []
        if kind == "report":
            out = [self._to(state, "resolved", row, "resolved", row["text"])]
            if state["escalated"]:
                out.append(("close", row["ts"], row["seq"], "resolved", "pending-reply-resolved"))
            return out
        if kind == "idle":
            if phase == "awaiting_report" and state["completed"] is None:
                state["completed"] = row["ts"]
            elif phase == "recovery_sent":
                return self._escalate(state, row, "missed")
            return []
        if kind == "outcome" and phase == "recovery_sending":
            if row["text"] == "confirmed":
                return [self._to(state, "recovery", row, "recovery_sent", None)]
            out = [self._to(state, "recovery", row, f"recovery_{row['text']}", None)]
            return out + self._escalate(state, row, "recovery-delivery")
        return []

    def _escalate(self, state: State, row: Row, why: str) -> list[tuple]:
        state["escalated"] = True
        return [self._to(state, "escalated", row, "escalated", why)]

    def due(self, state: State) -> int | None:
        if state["early"] is not None:
            return state["early"]["ts"] + self.wait
        if state["phase"] != "awaiting_report" or state["completed"] is None:
            return None
        return max(state["completed"], state["delivered"] + self.grace)

    def on_timer(self, state: State, at: int) -> list[tuple]:
        if (early := state["early"]) is not None:
            state["early"] = None
            return [("unmatched", at, early["seq"], "unmatched", str(early["n"]))]
        row = {"ts": at, "seq": state["seen"][1]}
        return [self._to(state, "send", row, "recovery_sending", None)]


@dataclass(frozen=True)
class OfferOnce:
    """A request is offered unless it was within ``ttl`` seconds, earlier or later: rows may come in any order. An offer is
    remembered for two times ``ttl``, so a row that comes up to ``ttl`` behind the watermark is still judged; one further
    behind, with no offer near it on record, is ``late``."""

    ttl: int
    columns: tuple[str, ...] = ()
    output: str = "kind string, ts long, seq long"
    any_order: bool = True

    def fresh(self) -> State:
        return {"offers": []}

    def keep(self, state: State) -> bool:
        return bool(state["offers"])

    def on_row(self, state: State, row: Row) -> list[tuple]:
        if any(abs(row["ts"] - at) < self.ttl for at in state["offers"]):
            return [("repeat", row["ts"], row["seq"])]
        if row["ts"] + self.ttl <= state["until"]:
            return [("late", row["ts"], row["seq"])]
        state["offers"] = sorted([*state["offers"], row["ts"]])
        return [("offer", row["ts"], row["seq"])]

    def due(self, state: State) -> int | None:
        return state["offers"][0] + 2 * self.ttl if state["offers"] else None

    def on_timer(self, state: State, at: int) -> list[tuple]:
        state["offers"] = [o for o in state["offers"] if o + 2 * self.ttl > at]
        return []
