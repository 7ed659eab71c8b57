"""Mirrors, cursors and bucketed ledgers: any order of files, breaks, rebuilds, repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import folds
from tidelog.sources import ledgers
from tidelog.streaming import jobs, mirror
from tidelog.streaming.buckets import BucketLedger

PIECES = "log string, at long, piece binary, prefix string, reason string"


def content(rng, n):
    return [rng.choice(["", "  ", "same", f"line {i} \x07ü", "x" * rng.randrange(150), f"n{i}"]) for i in range(n)]


def scrubbed(lines):
    """What a mirror of whole lines says: number and text of the first of each, blank ones left out."""
    said = {}
    for i, line in enumerate(lines, 1):
        if line.strip():
            said.setdefault("".join("?" if (c < " " and c not in "\t\n") or c == "\x7f" else c for c in line), i)
    return [(i, t) for t, i in said.items()]


def mirrored(spark, tmp_path, rows, files, max_bytes=4096):
    folder = str(tmp_path / "pieces")
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], PIECES).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(PIECES).option("maxFilesPerTrigger", 1).parquet(folder)
    with mirror.keyed_store(spark):
        out = jobs.run_to_table(mirror.mirror_log(source, max_bytes), str(tmp_path / "run"))
    return sorted((r["log"], r["seq"], r["line"]) for r in out.collect() if r["seq"]), [
        (r["log"], r["line"]) for r in out.collect() if r["seq"] is None]


def test_pieces_in_any_order_lose_nothing(spark, tmp_path):
    rng = random.Random(4)
    logs = {f"l{k}": content(rng, 60) for k in range(4)}
    lines = spark.createDataFrame([(k, i, t) for k, ls in logs.items() for i, t in enumerate(ls, 1)], "log string, seq long, line string")
    rows = [tuple(r) for r in mirror.cut_pieces(lines, 200).collect()]
    assert max(len(r[2]) for r in rows) <= 200
    for log in logs:  # pieces that overlap others, and some twice
        whole = b"".join(r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == log)
        assert whole == "".join(f"{t}\n" for t in logs[log]).encode()
        for _ in range(6):
            at = rng.randrange(len(whole))
            rows.append((log, at, whole[at : at + rng.randrange(400)], None, None))
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    said, alarms = mirrored(spark, tmp_path, rows, 6)
    assert alarms == []
    assert said == sorted((k, i, t) for k, ls in logs.items() for i, t in scrubbed(ls))


def test_digests_are_those_of_the_batch_form(spark):
    rng = random.Random(6)
    lines = content(rng, 40)
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate(lines, 1)], "log string, seq long, line string")
    cursor = mirror.Cursor()
    list(cursor.feed(0, "".join(f"{t}\n" for t in lines).encode(), None, None, 4096))
    assert cursor.digest() == ledgers.log_digest(df).first()["digest"]
    again = mirror.Cursor(*cursor.state())
    assert again.digest() == cursor.digest() and again.taken == cursor.taken


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]])
def test_a_break_is_said_once_and_ends_the_log(spark, tmp_path, order):
    rows = [("a", 0, b"one\ntwo\n", None, None), ("a", 8, b"", None, "truncated"), ("a", 8, b"three\n", "other", None),
            ("b", 0, b"fine\nand a rest", None, None)]
    said, alarms = mirrored(spark, tmp_path, [rows[i] for i in order], 4)
    assert said == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "fine")]
    assert len(alarms) == 1 and alarms[0][0] == "a"
    assert alarms[0][1].startswith("blocked [key=mirror-continuity-a]: mirror continuity broke (")


@pytest.mark.parametrize(("piece", "lines"), [(b"ok\n" + b"y" * 30 + b"\nz\n", ["ok"]), (b"ok\nfine\n" + b"y" * 20, ["ok", "fine"])])
def test_a_line_beyond_the_bound(piece, lines):
    cursor = mirror.Cursor()
    got = list(cursor.feed(0, piece, None, None, 20))
    assert [t.decode() for k, _, t in got if k == "line"] == lines and got[-1] == ("blocked", None, b"line-exceeds-bound")
    assert cursor.broken


class Counted(dict):
    """A map state as a dict that counts its calls."""

    calls = 0

    def _call(self, result=None):
        self.calls += 1
        return result

    def containsKey(self, key):  # noqa: N802
        return self._call(key in self)

    def getValue(self, key):  # noqa: N802
        return self._call(self[key])

    def updateValue(self, key, value):  # noqa: N802
        self._call(self.update({key: value}))

    def removeKey(self, key):  # noqa: N802
        self._call(self.pop(key))


def test_early_pieces_share_calls_of_the_store():
    """Fifty pieces that wait, over two triggers, and come due in a third: a few calls, not some for each piece."""
    store = Counted()
    for half in (0, 1):
        waiting = mirror.Waiting(store, 0)
        for at in range(200 * (1 + half), 10_200, 400):
            waiting.put(at, b"x" * 200, None, None)
        waiting.save()
    assert len(store) == 1
    waiting, taken, pieces = mirror.Waiting(store, 0), 200, 0
    while ready := waiting.due(taken):
        pieces, taken = pieces + len(ready), ready[-1][0] + len(ready[-1][1])
    waiting.save()
    assert (pieces, taken) == (50, 10_200) and not store and store.calls <= 8


@pytest.mark.parametrize("held", [1, 2, 16])
def test_waiting_pieces_against_a_plain_list(monkeypatch, held):
    monkeypatch.setattr(mirror, "_STRETCH", 64)
    monkeypatch.setattr(mirror, "_HELD", held)
    rng = random.Random(held)
    for _ in range(40):
        store, plain, taken = Counted(), {}, 0
        for trigger in range(8):
            waiting = mirror.Waiting(store, taken, trigger > 0)
            for _ in range(rng.randrange(12)):
                piece = (taken + rng.randrange(1, 400), b"y" * rng.randrange(300), None, rng.choice([None, None, "gone"]))
                waiting.put(*piece)
                name = (piece[0], piece[3] is not None)
                if name not in plain or len(plain[name][1]) < len(piece[1]):
                    plain[name] = piece
            if rng.random() < 0.6:
                taken += rng.randrange(1, 200)
                while True:
                    names = [n for n in ((taken, False), (taken, True)) if n in plain][:1]
                    want = [plain.pop(n) for n in names or sorted(n for n in plain if n[0] < taken)]
                    got = waiting.due(taken)
                    assert got == want
                    if not got:
                        break
                    taken = max([taken, *(at + len(p) for at, p, *_ in got)])
            waiting.save()
        assert sum(len(mirror.pickle.loads(v[0])) for v in store.values()) == len(plain)


# --- cursors of the open set -----------------------------------------------------------------


class Logs:
    """Logs as a test changes them, and the reader that the job is given."""

    def __init__(self, spark):
        self.spark, self.lines, self.ident, self.taken, self.short = spark, {}, {}, [], set()

    def look(self, n, unreadable=()):
        rows = [(t, n, None if t in unreadable else self.ident[t], len(ls)) for t, ls in self.lines.items()]
        return self.spark.createDataFrame(rows, "task long, look long, ident string, size long")

    def read(self, plan):
        rows = [(t, i, line) for t, ls in self.lines.items() for i, line in enumerate(ls, 1)]
        all_lines = self.spark.createDataFrame(rows, "task long, seq long, line string")
        wanted = all_lines.join(plan, "task").filter("seq > past AND seq <= size")
        wanted = wanted.filter(~F.col("task").isin(self.short) | (F.col("seq") % 2 == 0)) if self.short else wanted
        self.taken.append(wanted.count())
        return tx.parse_status(wanted.select("task", "seq", "line"))

    def full(self, tasks):
        rows = [(t, i, line) for t in tasks for i, line in enumerate(self.lines[t], 1)]
        lines = tx.parse_status(self.spark.createDataFrame(rows, "task long, seq long, line string"))
        return {tuple(r) for r in folds.open_decisions(lines).select("task", "key", "seq", "verb", "note").collect()}


def test_cursors_are_kept_rebuilt_and_trusted(spark, tmp_path):
    path = str(tmp_path / "fold")
    logs = Logs(spark)
    fn = jobs.fold_logs(logs.read, path, buckets=4)
    now = lambda: {tuple(r) for r in jobs.folded_set(spark, path, buckets=4).collect()}
    filler = [f"working: filler {i}" for i in range(40)]
    for t in range(5):
        logs.lines[t] = [f"needs-decision [key=k{t}]: pick", *filler, "blocked [key=b]: wait"]
        logs.ident[t] = f"i{t}"
    fn(logs.look(1), 0)
    assert now() == logs.full(range(5)) and len(now()) == 10
    first = now()
    # Growth: only the new lines are read, buried decisions stay; the batch may run again.
    for t in range(5):
        logs.lines[t] += ["working: more"] * 3
    logs.lines[0].append("resolved [key=k0]: done")
    for _ in range(2):
        fn(logs.look(2), 1)
        assert logs.taken[-1] == 16 and now() == logs.full(range(5)) and len(now()) == 9
    # 1 shrinks, 2 is replaced, 3 cannot be looked at, 4 gives too few lines; each of the last two would lose a decision.
    logs.lines[1] = logs.lines[1][:1]
    logs.lines[2], logs.ident[2] = ["blocked [key=new]: other file", *["working: x"] * 80], "again"
    for t in (3, 4):
        logs.lines[t].append(f"resolved [key=k{t}]: gone")
    logs.lines[4].append("working: y")
    logs.short = {4}
    kept = {r for r in now() if r[0] in (3, 4)}
    fn(logs.look(3, unreadable=[3]), 2)
    assert now() == logs.full([0, 1, 2]) | kept and kept == {r for r in first if r[0] in (3, 4)}
    # Readable again: they go on from where they were trusted.
    logs.short = set()
    logs.taken.clear()
    fn(logs.look(4), 3)
    assert now() == logs.full(range(5)) and logs.taken[-1] == 3
    # An empty log, and nothing new at all.
    logs.lines[1] = []
    fn(logs.look(5), 4)
    assert now() == logs.full([0, 2, 3, 4])
    # Another meaning of the fold: everything is read once more.
    logs.taken.clear()
    jobs.fold_logs(logs.read, path, version=2, buckets=4)(logs.look(6), 5)
    assert logs.taken[-1] == sum(map(len, logs.lines.values())) and now() == logs.full([0, 2, 3, 4])


# --- ledgers ---------------------------------------------------------------------------------


def counted(monkeypatch):
    read, seen = BucketLedger.read, []

    def spy(self, spark, buckets=None, before=None):
        df = read(self, spark, buckets, before)
        if buckets is not None:
            seen.append(df.count())
        return df

    monkeypatch.setattr(BucketLedger, "read", spy)
    return seen


def test_a_trigger_reads_only_its_buckets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "open")
    fn = jobs.apply_moves(path)
    schema = "task long, key string, seq long, verb string, note string, is_open boolean"
    fn(spark.createDataFrame([(t, "k", 1, "blocked", "n", True) for t in range(3000)], schema), 0)
    seen = counted(monkeypatch)
    for n in range(1, 21):
        moves = [(t, "k", n + 1, "blocked", f"n{n}", True) for t in (5, 6)] + [(7, "k", n + 1, "resolved", "", False)]
        fn(spark.createDataFrame(moves, schema), n)
    assert len(seen) == 20 and max(seen) - min(seen) <= 1 and max(seen) < 3000 * 3 / 64 * 2
    rows = {r["task"]: r["note"] for r in jobs.open_set(spark, path).collect()}
    assert len(rows) == 2999 and rows[5] == rows[6] == "n20" and 7 not in rows
    manifests = [f for f in (tmp_path / "open" / "manifest").iterdir() if f.name.startswith("batch=")]
    kept = [f for g in (tmp_path / "open").glob("gen=*") for f in g.glob("__bucket=*")]
    assert len(manifests) == 2 and len(kept) <= 64 + 3


def test_a_ledger_batch_may_run_again(spark, tmp_path):
    out = str(tmp_path / "out")
    fn = jobs.consume_events({"too big": F.col("bytes") > 10}, out, buckets=4)
    batches = [[("a", 1), ("b", 99), ("a", 1)], [("a", 1), ("c", 2)], [("b", 3), ("c", 2)], [("d", 1)], []]
    for n, rows in enumerate(batches):
        for _ in range(2):
            fn(spark.createDataFrame(rows, "event_id string, bytes int"), n)
    got = lambda name: sorted((r.batch_id, r.event_id) for r in spark.read.parquet(f"{out}/{name}").collect())
    assert got("accepted") == [(0, "a"), (1, "c"), (2, "b"), (3, "d")] and got("rejected") == [(0, "b")]
    left = BucketLedger(f"{out}/ledger", ["event_id"], "event_id string", 4).read(spark)
    assert sorted(r[0] for r in left.collect()) == ["a", "b", "c", "d"]


def test_announced_until_handled_in_any_order(spark, tmp_path):
    out = str(tmp_path / "out")
    fn = jobs.reannounce(out, buckets=4)
    schema = "source long, seq long, path string, kind string"
    row = lambda s, kind: (s, 10 * s, f"p{s}" if kind == "result" else None, kind)
    batches = [[row(1, "result"), row(2, "handled")], [row(2, "result"), row(3, "result")], [], [row(1, "handled"), row(3, "result")],
               [row(3, "handled"), row(1, "result")]]
    want = [{1}, {1, 3}, {1, 3}, {3}, set()]
    for n, rows in enumerate(batches):
        for _ in range(2):
            fn(spark.createDataFrame(rows, schema), n)
        said = spark.read.schema("source long, seq long, path string").parquet(f"{out}/announced/batch_id={n}").collect()
        assert {r["source"] for r in said} == want[n] and all(r["path"] == f"p{r['source']}" for r in said)


def test_a_sweep_is_silent_on_what_it_surfaced(spark, tmp_path):
    out = str(tmp_path / "out")
    logs = {1: ["working: a", "done: one"], 2: ["blocked: two"], 3: ["working: quiet"]}

    def read(spark, now):
        rows = [(t, i, line.split(":")[0], line) for t, ls in logs.items() for i, line in enumerate(ls)]
        return spark.createDataFrame(rows, "task long, seq long, verb string, line string")

    fn = jobs.timed_sweep(read, out, every=300, buckets=2)

    def tick(batch, now):
        fn(spark.createDataFrame([(now - 5,), (now,)], "now long"), batch)
        try:
            return sorted(r["line"] for r in spark.read.parquet(f"{out}/surfaced/batch_id={batch}").collect())
        except Exception:  # noqa: BLE001 - no sweep was due
            return None

    assert tick(0, 1000) == tick(0, 1000) == ["blocked: two", "done: one"]
    logs[2].append("failed: three")
    assert tick(1, 1200) is None
    assert tick(2, 1300) == tick(2, 1300) == ["failed: three"]
    assert tick(3, 1900) == []
    logs[2].append("blocked: two")
    assert tick(4, 2500) == ["blocked: two"]
