"""Column expressions for log lines and row text. All of them stay inside JVM code generation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.vocab import (
    DEFAULT_VOCABULARY,
    MESSAGE_MARK,
    RELEVANT_TEXT,
    TERMINAL_VERBS,
    Vocabulary,
)

# A full date, an optional time with seconds, fraction and zone, then whitespace. The possessive
# quantifiers forbid giving characters back, so an unfinished part leaves the line untouched.
_TIME = r"(?:[Tt ]\d\d:\d\d(?::\d\d)?+(?:\.\d++)?+(?:[Zz]|[+-]\d\d:\d\d|[+-]\d{4}|[+-]\d\d)?+)?+"
_STAMP = rf"^\s*+(?:\[\d{{4}}-\d\d-\d\d{_TIME}\]|\d{{4}}-\d\d-\d\d{_TIME})(?=\s)\s*+"
_KEY_TOKEN = r"\[key=([^\]]*)\]"
_KEY_SLUG = r"^[A-Za-z0-9._-]+$"

CAP_SUFFIX = " [truncated]"
ELLIPSIS = "…"

# Patterns of the failure, superseded and correlation rules.
FAILED_LINE = r"STUCK:|FAILED:|needs attention|(^|\s)ALERT(\s|$)"
SUPERSEDED = "(?i)SUPERSEDED|NOT REQUIRED|NOT-REQUIRED|DEFERRED"
CORRELATION = "corr=([A-Fa-f0-9]{16})"
FAILING_CONCLUSIONS = ("FAILURE", "ERROR", "TIMED_OUT", "CANCELLED", "ACTION_REQUIRED")
URL = r'https?://[^\s)"<>]+'


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def trim_space(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def tail_from(col: Column, position: Column) -> Column:
    """Text from a 1-based position to the end."""
    return F.substring(col, position, F.length(col))


def strip_ts(col: Column) -> Column:
    """Drop a leading ISO timestamp, bare or bracketed, when it is complete."""
    return F.regexp_replace(col, _STAMP, "")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that filters use as well. A filter moves below a projection by copying
    the column's expression, once per mention; unpacking a one-element array keeps it above, so
    every column is computed once per row."""
    fields = [c.alias(name) for name, c in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*fields))))


def parse_status(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``verb``, ``key`` and ``note``. A malformed key gives a null key: folds ignore the row."""
    text, head = F.col("__text"), F.col("__head")
    token = F.regexp_extract(head, _KEY_TOKEN, 1)
    after_colon = tail_from(text, F.instr(text, ":") + 1)
    key = F.when(~head.contains("[key="), "default").when(token.rlike(_KEY_SLUG), token)
    key = F.when(head.contains("[key=") & ~head.rlike(_KEY_TOKEN), "default").otherwise(key)
    note = F.when(text.contains(":"), F.regexp_replace(after_colon, r"^\s+", "")).otherwise(text)
    verb = trim_space(F.substring_index(head, "[key=", 1))
    prepared = df.withColumn("__text", strip_ts(F.col(line))).withColumn(
        "__head", F.substring_index("__text", ":", 1))
    return computed(prepared, verb=verb, key=key, note=note).drop("__text", "__head")


def is_paused(verb: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    return verb == vocab.paused


def is_paused_or_held(verb: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    return verb.isin(vocab.paused, vocab.held)


def is_terminal(verb: Column) -> Column:
    return verb.isin(*TERMINAL_VERBS)


def is_relevant(verb: Column, line: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Should this line reach the supervisor? Progress verbs never; terminal verbs always, unless
    the free-text pattern is overridden; anything else by the pattern."""
    quiet = verb.isin("working", "resolved", "captain-held", vocab.paused)
    by_text = line.rlike("(?i)" + (vocab.relevant_text or RELEVANT_TEXT))
    loud = by_text if vocab.relevant_text is not None else is_terminal(verb) | by_text
    return ~quiet & (line != "") & loud


def transition_allowed(
    key: Column, note: Column, prefixes: Sequence[str] = DEFAULT_VOCABULARY.reserved_prefixes
) -> Column:
    """A key in a reserved namespace moves only on a note that opens with ``<prefix>...:``."""
    allowed = F.lit(True)
    for prefix in reversed(prefixes):
        speaks = note.startswith(prefix) & tail_from(note, F.lit(len(prefix) + 1)).contains(":")
        allowed = F.when(key.startswith(prefix), speaks).otherwise(allowed)
    return allowed


def verb_state(verb: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    return (
        F.when(verb == vocab.paused, "paused")
        .when(verb.isin("working", "blocked", "done", "failed"), verb)
        .when(verb == "needs-decision", "parked")
        .otherwise("unknown")
    )


def transition_policy(to_status: Column) -> Column:
    return (
        F.when(to_status == "blocked", "actionable")
        .when(to_status == "working", "absorb")
        .when(to_status.isin("idle", "done"), "defer")
        .otherwise("fallback")
    )


def cap_line(col: Column, limit: int = 220) -> Column:
    """At most ``limit`` characters, the truncation suffix included."""
    keep = max(limit - len(CAP_SUFFIX), 0)
    cut = F.concat(F.substring(col, 1, keep), F.lit(CAP_SUFFIX))
    return F.when(F.length(col) <= limit, col).otherwise(cut)


def ellipsize(col: Column, limit: int) -> Column:
    """Whitespace runs become one space; beyond ``limit`` characters an ellipsis is added."""
    flat = F.regexp_replace(col, r"\s+", " ")
    cut = F.concat(F.substring(flat, 1, limit), F.lit(ELLIPSIS))
    return F.when(F.length(flat) > limit, cut).otherwise(flat)


def clean_text(col: Column, policy: str = "spaces") -> Column:
    """``spaces``: TAB/CR/LF to spaces. ``squeeze``: drop other controls, one space per run, trim
    one space at each end. ``mask``: controls other than TAB and LF become ``?``."""
    if policy == "spaces":
        return F.translate(col, "\t\r\n", "   ")
    if policy == "squeeze":
        kept = F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
        spaced = F.regexp_replace(F.translate(kept, "\t\n\r", "   "), " +", " ")
        return F.regexp_replace(spaced, "^ | $", "")
    if policy == "mask":
        return F.regexp_replace(col, r"[\x00-\x08\x0B-\x1F\x7F]", "?")
    raise ValueError(f"unknown policy: {policy}")


def extract_links(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(f"({URL})"), 1)


def first_change_link(links: Column) -> Column:
    """First link that points at a numbered pull request."""
    return F.get(F.filter(links, lambda u: u.rlike("/pull/[0-9]+")), F.lit(0))


def capture(col: Column, pattern: str, group: int = 1) -> Column:
    """Trimmed capture, null when the pattern does not match. Patterns that begin with a wildcard
    must be anchored, or a failing search starts over at every character."""
    return F.when(col.rlike(pattern), trim_space(F.regexp_extract(col, pattern, group)))


def extract_meta(col: Column, key: str) -> Column:
    """``(key: value)`` or ``, key: value`` inside row text; the last occurrence wins."""
    return _where_held(col, key, capture(col, rf"^.*(?:\(|,\s*){key}:\s*([^,)]*)"))


def extract_meta_word(col: Column, key: str) -> Column:
    """``(key value)`` inside row text; the last occurrence wins."""
    return _where_held(col, key, capture(col, rf"^.*(?:\(|,\s*){key}\s+([^,)]*)"))


def _where_held(col: Column, key: str, found: Column) -> Column:
    """Most texts lack most keys: a plain search is cheaper than the pattern, which goes back over the whole text."""
    return F.when(col.contains(key), found) if re.fullmatch(r"[A-Za-z0-9_-]+", key) else found


def check_rollup(checks: Column) -> Column:
    """Array of ``struct<conclusion,state,status>`` to none / failing / pending / passing."""
    def failing(c: Column) -> Column:
        outcome = F.coalesce(c["conclusion"], c["state"], F.lit(""))
        return outcome.isin(*FAILING_CONCLUSIONS)

    def waiting(c: Column) -> Column:
        status = F.coalesce(c["status"], F.lit(""))
        return (status != "COMPLETED") & (F.coalesce(c["state"], F.lit("")) != "SUCCESS")

    return (
        F.when(F.coalesce(F.size(checks), F.lit(0)) <= 0, "none")
        .when(F.exists(checks, failing), "failing")
        .when(F.exists(checks, waiting), "pending")
        .otherwise("passing")
    )


def is_superseded(body: Column) -> Column:
    return F.coalesce(body, F.lit("")).rlike(SUPERSEDED)


def est_tokens(col: Column) -> Column:
    return F.ceil(F.octet_length(col) / 3).cast("long")


def line_failed(col: Column) -> Column:
    return col.rlike(FAILED_LINE)


def derive_event_id(*cols: Column) -> Column:
    """SHA-256 over the identity fields joined by the unit separator; null counts as empty."""
    fields = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("\u001f", *fields), 256)


def extract_corr(col: Column) -> Column:
    """First correlation token, lower case; null without one. A line that reports a missed reply
    never counts as an answer."""
    token = F.lower(F.regexp_extract(col, CORRELATION, 1))
    return F.when((token != "") & ~col.contains("pending-reply-missed"), token)


def resolve_via(line: Column) -> Column:
    """How an answering line acknowledged its request; the first rule that fits wins."""
    return (
        F.when(
            line.rlike(r"(?s)data/.*report") | line.contains("report.md")
            | line.contains("document") | line.contains("pointer"),
            "document",
        )
        .when(line.contains("via-helper") | line.contains("mate-report"), "helper")
        .otherwise("status")
    )


def message_kind(text: Column, kinds: Sequence[str], label: str, version: str = "v1") -> Column:
    """Kind from a structural header ``<mark><label>: <version> <kind>: <body>``; unknown kinds and
    empty bodies are ordinary messages."""
    head = f"{MESSAGE_MARK}{label}: {version} "
    rest = tail_from(text, F.lit(len(head) + 1))
    kind = F.substring_index(rest, ": ", 1)
    body = tail_from(rest, F.length(kind) + 3)
    ok = text.startswith(head) & rest.contains(": ") & kind.isin(*kinds) & (body != "")
    return F.when(ok, kind).otherwise("ordinary")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session zone is."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return days * 86400 + clock


#: Version and fields of a busy record, and the form of each.
BUSY_VERSION = "v1"
BUSY_FIELDS = {
    "gen": "^[A-Za-z0-9._-]+$",
    "seq": "^[0-9]+$",
    "state": "^(busy|idle|unknown)$",
    "source": "^[A-Za-z0-9._-]+$",
    "event": "^[A-Za-z0-9._-]+$",
    "ts": "^[0-9]+$",
}


def parse_busy(record: Column) -> Column:
    """A busy record, ``v1 gen=… seq=… state=… source=… event=… ts=…`` and a newline, as a struct of its fields and
    ``fault``: null, or the first of ``lines`` (not one line), ``version``, ``unknown-field`` and the name of a field
    that is absent or ill-formed. Blanks separate fields, of a repeated one the last counts, order is free."""
    parts = F.filter(F.split(F.split_part(record, F.lit("\n"), F.lit(1)), " "), lambda x: x != "")
    given = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    known = "^(" + "|".join(BUSY_FIELDS) + ")="

    def value(name: str) -> Column:
        last = F.try_element_at(F.filter(given, lambda x: F.startswith(x, F.lit(f"{name}="))), F.lit(-1))
        return F.substring(last, len(name) + 2, 2147483647)

    values = {name: value(name) for name in BUSY_FIELDS}
    fault = (
        F.when(record.isNull() | (F.length(record) - F.length(F.replace(record, F.lit("\n"))) != 1), "lines")
        .when(~F.coalesce(F.get(parts, F.lit(0)), F.lit("")).eqNullSafe(BUSY_VERSION), "version")
        .when(F.exists(given, lambda x: ~x.rlike(known)), "unknown-field")
    )
    for name, form in BUSY_FIELDS.items():
        fault = fault.when(~F.coalesce(values[name], F.lit("")).rlike(form), name)
    return F.struct(
        *[F.when(fault.isNull(), v).alias("record_seq" if n == "seq" else n) for n, v in values.items()], fault.alias("fault"))
