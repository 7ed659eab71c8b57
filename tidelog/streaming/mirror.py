"""Mirror of growing logs as a keyed stream with a cursor per log.

A piece is a stretch of a log as some reader saw it: any number of bytes, from any place, in any order, in any file. State
per log: how far the log has been taken, the unfinished last line, a running digest of the whole lines (the one of
:func:`tidelog.sources.ledgers.log_digest`), and the pieces that came before what they follow on. Whole lines come out in
order as soon as they are complete, scrubbed, without blank ones, each text once per log. A piece that names another
digest for the lines before it, a line beyond the bound, or a break that the reader reports, becomes one ``blocked`` line,
and the log stops for good. Nothing is cut off: ``max_bytes`` bounds a line, not what a trigger may take.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.functions import digests
from tidelog.functions.digests import LANES
from tidelog.operators import ordered

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Controls other than TAB and LF become question marks. They are single bytes in UTF-8, so lines are scrubbed as bytes.
_SCRUB = bytes(0x3F if (b < 0x20 and b not in (9, 10)) or b == 0x7F else b for b in range(256))
#: Bytes of a log whose early pieces are one entry of the store, and such entries that a call keeps in memory.
_STRETCH, _HELD = 1 << 15, 16
_LANES = struct.Struct(f">{LANES}I")
_Line = Row("log", "seq", "kind", "line")
#: ``at, piece, prefix, reason``.
Piece = tuple[int, bytes, str | None, str | None]


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """State by key for streams started inside: variables of ``transformWithState`` need a store that reads single keys."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Cursor:
    """Place and running digest of one log. Plain data, so that the rules can be tried without a stream."""

    def __init__(self, lines: int = 0, taken: int = 0, rest: bytes = b"", sums: str = "", broken: bool = False) -> None:
        self.lines, self.taken, self.rest, self.broken = lines, taken, rest, broken
        self.sums = [int(x) for x in sums.split(":")] if sums else [0] * LANES

    def state(self) -> tuple:
        return self.lines, self.taken, self.rest, ":".join(map(str, self.sums)), self.broken

    def digest(self) -> str | None:
        """Digest of the whole lines so far; none of nothing."""
        if not self.lines:
            return None
        return hashlib.sha256(":".join(map(str, [self.lines, *self.sums])).encode()).hexdigest()

    def feed(self, at: int, piece: bytes, prefix: str | None, reason: str | None, max_bytes: int) -> Iterator[tuple[str, int | None, bytes]]:
        """``kind, number, text`` of what a piece that begins at or before the cursor's place adds."""
        if reason is not None:
            if at == self.taken:  # a break seen at another place tells nothing of this cursor
                yield self._stop(reason)
            return
        data = piece[self.taken - at :]
        if not data:
            return
        if at == self.taken and prefix is not None and prefix != self.digest():
            yield self._stop("prefix-changed")
            return
        self.taken += len(data)
        *whole, self.rest = (self.rest + data).split(b"\n")
        for line in whole:
            if len(line) + 1 > max_bytes:
                yield self._stop("line-exceeds-bound")
                return
            self.lines += 1
            word = hashlib.sha256(f"{self.lines}\x1f".encode() + line).digest()
            self.sums = [a + b for a, b in zip(self.sums, _LANES.unpack_from(word), strict=True)]
            if line.strip():
                yield "line", self.lines, line.translate(_SCRUB)
        if len(self.rest) >= max_bytes:
            yield self._stop("line-exceeds-bound")

    def _stop(self, why: str) -> tuple[str, None, bytes]:
        self.broken, self.rest = True, b""
        return "blocked", None, why.encode()


class Store(Protocol):
    """What :class:`Waiting` needs of a map state."""

    def containsKey(self, key: tuple) -> bool: ...  # noqa: N802

    def getValue(self, key: tuple) -> tuple: ...  # noqa: N802

    def updateValue(self, key: tuple, value: tuple) -> None: ...  # noqa: N802

    def removeKey(self, key: tuple) -> None: ...  # noqa: N802


class Waiting:
    """Pieces of a log that came before what they follow on. Those that begin in one stretch of the log are one entry of
    the store, as every call of the store costs more than reading a piece; an entry is read when the cursor or another
    piece comes into its stretch. Between triggers all lie behind the cursor's place."""

    def __init__(self, store: Store, taken: int, known: bool = True) -> None:
        """``known``: whether the log has been seen by an earlier trigger."""
        self.store, self.known, self.low = store, known, taken // _STRETCH
        self.written: set[int] = set()
        # Pieces by place and whether they are a break; whether the store has them, and has them otherwise.
        self.pieces: dict[int, dict[tuple[int, bool], tuple]] = {}
        self.stored: dict[int, bool] = {}
        self.changed: set[int] = set()

    def _stretch(self, no: int) -> dict[tuple[int, bool], tuple]:
        if no not in self.pieces:
            while len(self.pieces) >= _HELD:
                self._write(next(iter(self.pieces)))
            self.stored[no] = (self.known or no in self.written) and self.store.containsKey((no,))
            self.pieces[no] = pickle.loads(bytes(self.store.getValue((no,))[0])) if self.stored[no] else {}
        return self.pieces[no]

    def _write(self, no: int) -> None:
        some, stored = self.pieces.pop(no), self.stored.pop(no)
        if no in self.changed:
            self.changed.remove(no)
            if some:
                self.store.updateValue((no,), (pickle.dumps(some),))
                self.written.add(no)
            elif stored:
                self.store.removeKey((no,))

    def put(self, at: int, piece: bytes, prefix: str | None, reason: str | None) -> None:
        """Of pieces that begin at one place the longest waits."""
        no, name = at // _STRETCH, (at, reason is not None)
        some = self._stretch(no)
        if name not in some or len(some[name][0]) < len(piece):
            some[name] = piece, prefix, reason
            self.changed.add(no)

    def due(self, taken: int) -> list[Piece]:
        """Pieces that follow on the cursor's place; they wait no longer."""
        here = taken // _STRETCH
        for name in ((taken, False), (taken, True)):
            if name in self._stretch(here):
                return [self._take(here, name)]
        # None begins just here: some may have begun before, where pieces overlap.
        found = [self._take(no, name) for no in range(self.low, here + 1)
                 for name in sorted(self._stretch(no)) if name[0] < taken]
        self.low = here
        return found

    def _take(self, no: int, name: tuple[int, bool]) -> Piece:
        self.changed.add(no)
        return name[0], *self._stretch(no).pop(name)

    def save(self) -> None:
        for no in list(self.pieces):
            self._write(no)


class Mirror(StatefulProcessor):
    """Takes the pieces of a log in order of place, whatever the order in which they come."""

    def __init__(self, max_bytes: int) -> None:
        self.max_bytes = max_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "lines long, taken long, rest binary, sums string, broken boolean")
        self.waiting = handle.getMapState("stretches", "stretch long", "pieces binary")

    def _take(self, log: object, cursor: Cursor, some: list[Piece], said: set[bytes]) -> Iterator[Row]:
        for at, piece, prefix, reason in some:
            for kind, number, text in cursor.feed(at, piece, prefix, reason, self.max_bytes):
                if kind == "line":
                    if text in said:
                        continue
                    said.add(text)
                yield _Line(log, number, kind, text.decode("utf-8", "replace"))
            if cursor.broken:
                return

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        known = self.cursor.exists()
        cursor = Cursor(*self.cursor.get()) if known else Cursor()
        cursor.rest = bytes(cursor.rest)
        came = sorted(((r["at"], bytes(r["piece"] or b""), r["prefix"], r["reason"]) for r in rows),
                      key=lambda r: (r[0], r[3] is not None, len(r[1])))
        if cursor.broken:
            return
        said: set[bytes] = set()
        waiting = Waiting(self.waiting, cursor.taken, known)
        early = 0
        for piece in came:
            if piece[0] <= cursor.taken:
                yield from self._take(key[0], cursor, [piece], said)
            else:
                waiting.put(*piece)
                early += 1
            if cursor.broken:
                break
        # What waits can follow only when something came that was not early.
        while early < len(came) and not cursor.broken and (ready := waiting.due(cursor.taken)):
            yield from self._take(key[0], cursor, ready, said)
        if cursor.broken:
            self.waiting.clear()
        else:
            waiting.save()
        self.cursor.update(cursor.state())

    def close(self) -> None:
        pass


def mirror_log(pieces: DataFrame, max_bytes: int = 65536) -> DataFrame:
    """Stream of ``log, seq, line`` from a stream of ``log, at, piece, prefix, reason``.

    ``at``: bytes of the log before the piece; ``prefix``: digest of the whole lines among them, null where the reader
    does not say (before the first line it is null); ``reason``: null, or the break that the reader found at ``at``
    (``truncated``, ``missing`` …). ``seq`` is the number of the line, null for ``blocked`` lines. Needs
    :func:`keyed_store`. All pieces of a log that one trigger brings are taken by one task: bound the trigger."""
    kind = pieces.schema["log"].dataType.simpleString()
    rows = pieces.select("log", F.col("at").cast("long"), F.col("piece").cast("binary"), "prefix", "reason")
    lines = rows.groupBy("log").transformWithState(
        statefulProcessor=Mirror(max_bytes), outputStructType=f"log {kind}, seq long, kind string, line string",
        outputMode="append", timeMode="none")
    alarm = F.concat(F.lit("blocked [key=mirror-continuity-"), F.col("log").cast("string"),
                     F.lit("]: mirror continuity broke ("), F.col("line"), F.lit(")"))
    # Texts that an earlier trigger brought; those of one trigger were told apart above.
    return lines.withColumn("line", F.when(F.col("kind") == "blocked", alarm).otherwise(F.col("line"))).dropDuplicates(
        ["log", "line"]).select("log", "seq", "line")


def cut_pieces(lines: DataFrame, size: int) -> DataFrame:
    """Whole logs (``log, seq, line``, ``seq`` from 1) as pieces of ``size`` bytes that end anywhere, with the digests
    that a reader would name. Running totals are those of :func:`tidelog.operators.ordered.scan`."""
    own = digests.element_lanes(F.concat_ws("\u001f", F.col("seq").cast("string"), F.col("line")))
    names = [f"w{i}" for i in range(digests.LANES)]
    held = lines.select("log", "seq", F.concat(F.col("line"), F.lit("\n")).cast("binary").alias("body"),
                        *[w.alias(n) for w, n in zip(own, names, strict=True)]).withColumn("bytes", F.octet_length("body").cast("long"))
    run = ordered.scan(held, ["log"], "seq", total={"until": F.col("bytes")} | {f"t{n}": F.col(n) for n in names})
    start = F.col("until") - F.col("bytes")
    # The digest of the lines before this one.
    before = [(F.col(f"t{n}") - F.col(n)).cast("string") for n in names]
    prefix = F.when(F.col("seq") > 1, F.sha2(F.concat_ws(":", (F.col("seq") - 1).cast("string"), *before), 256))
    first, last = F.floor(start / size), F.floor((F.col("until") - 1) / size)
    parts = run.select("log", "seq", "body", start.alias("start"), prefix.alias("prefix"), F.explode(F.sequence(first, last)).alias("no"))
    low = F.greatest(F.col("no") * size - F.col("start"), F.lit(0))
    high = F.least((F.col("no") + 1) * size - F.col("start"), F.octet_length("body").cast("long"))
    text = F.expr("substring(body, cast(__low AS INT) + 1, cast(__high - __low AS INT))")
    cut = parts.withColumns({"__low": low, "__high": high}).select("log", "no", "seq", text.alias("text"), "prefix")
    # A piece has at most ``size`` bytes, so what is gathered for it is bounded.
    whole = cut.groupBy("log", "no").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "prefix"))).alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda done, p: F.concat(done, p["text"]))
    return whole.select("log", (F.col("no") * size).alias("at"), joined.alias("piece"), F.col("parts")[0]["prefix"].alias("prefix"),
                        F.lit(None).cast("string").alias("reason"))
