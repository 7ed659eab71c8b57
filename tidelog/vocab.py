"""Overridable vocabularies and thresholds, passed as arguments to every operator that uses them."""

from __future__ import annotations

from dataclasses import dataclass

# Verbs of the status log grammar.
OPEN_VERBS = ("needs-decision", "blocked")
TERMINAL_VERBS = ("done", "needs-decision", "blocked", "failed")
ACTIVITY_VERBS = ("working",)
ACTIVITY_CLOSERS = ("done", "failed", "needs-decision", "blocked")

# Free-text tokens that make a line without a known verb relevant.
RELEVANT_TEXT = (
    "done:|needs-decision:|blocked:|failed:|PR ready|checks green|ready in branch|merged"
)

# Queue kinds and message kinds.
WAKE_KINDS = ("signal", "stale", "check", "heartbeat")
MESSAGE_KINDS = ("session-start", "watcher", "turn-end-guard", "away-supervisor", "launch-brief")

# Fixed value: the invisible separator that opens a structural message header (U+2063).
MESSAGE_MARK = "\u2063"


@dataclass(frozen=True)
class Vocabulary:
    """Words a deployment may override. ``relevant_text=None`` keeps the default pattern
    together with the rule that terminal verbs are always relevant; a custom pattern
    replaces both."""

    paused: str = "paused"
    resolved: str = "resolved"
    held: str = "captain-held"
    reserved_prefixes: tuple[str, ...] = ("pending-reply-",)
    relevant_text: str | None = None
    skip_prefixes: tuple[str, ...] = ("heartbeat",)


@dataclass(frozen=True)
class Thresholds:
    """Default bounds in seconds, rows, characters or bytes."""

    stale_escalate: int = 240
    pause_resurface: int = 3600
    progress_ceiling: int = 5400
    busy_turn_max: int = 14400
    demand_inspect_count: int = 3
    batch_secs: int = 90
    max_defer: int = 300
    signal_grace: int = 30
    reply_grace: int = 120
    early_reply_wait: int = 86400
    sweep_secs: int = 300
    followup_cap: int = 3
    followup_age: int = 604800
    line_cap: int = 220
    event_bytes_max: int = 8192


DEFAULT_VOCABULARY = Vocabulary()
DEFAULT_THRESHOLDS = Thresholds()
