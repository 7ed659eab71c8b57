"""Streams give what their batch rule gives, in one micro-batch and in seven, and batch functions
may run again."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import folds
from tidelog.operators import suppression as sup
from tidelog.sources import ledgers
from tidelog.streaming import jobs, keyed, rules
from tidelog.vocab import Thresholds

LIMITS = Thresholds(stale_escalate=240, pause_resurface=900, progress_ceiling=900)


def make_rows(seed, n=420):
    rng = random.Random(seed)
    rows, ts = [], 1_700_000_000
    for seq in range(n):
        ts += rng.choice([0, 1, 20, 60, 400])
        rows.append({
            "entity": 0 if rng.random() < 0.5 else rng.randrange(1, 4), "ts": ts, "seq": seq,
            "kind": rng.choice(["poll"] * 4 + ["check", "log"]), "hash": seq // 60 % 2, "busy": rng.random() < 0.05,
            "phase": rng.choice(["working"] * 5 + ["parked", "done"]), "token": f"t{seq // 90}",
            "agent": "dead" if rng.random() < 0.05 else "alive", "verb": rng.choice(["paused", "working"])})
    return rows


def streamed(spark, tmp_path, rows, schema, parts):
    """Rows as a stream of ``parts`` files, one per micro-batch, in order."""
    path = str(tmp_path / f"in-{parts}")
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def model(rule, rows, key, until):
    out, states = [], {}
    for k in sorted({r[key] for r in rows}):
        mine = [{c: r[c] for c in ("ts", "seq", *rule.columns)} for r in rows if r[key] == k]
        out += [(k, *o) for o in keyed.replay(rule, states.setdefault(k, rule.fresh()), mine, until)]
    return sorted(out, key=str)


TIMER_SCHEMA = ("entity int, ts long, seq long, kind string, hash long, busy boolean, phase string, token string, "
                "agent string, verb string")


@pytest.mark.parametrize("parts", [1, 7])
def test_timers(spark, tmp_path, parts):
    rows = make_rows(5)
    rule = rules.Timers(limits=LIMITS)
    stream = jobs.stream_timers(streamed(spark, tmp_path, rows, TIMER_SCHEMA, parts), limits=LIMITS)
    got = jobs.run_to_table(stream, str(tmp_path / f"run-{parts}"))
    top = rows[-1]["ts"]
    want = [r for r in model(rule, rows, "entity", top) if r[2] < top]
    assert sorted((tuple(r) for r in got.collect() if r.ts < top), key=str) == want
    assert {r[1] for r in want} == {"wedge", "stall", "pause"}


def test_timer_rules_equal_batch_rules(spark):
    rows = make_rows(6, 700)
    df = spark.createDataFrame(rows, TIMER_SCHEMA)
    steps = model(rules.Timers(limits=LIMITS), rows, "entity", 0)
    wedges = sup.wedge_escalations(df.filter("kind = 'poll'"), limits=LIMITS)
    assert sorted((r.entity, r.seq, r.escalation, r.idle_secs) for r in wedges.collect()) == sorted(
        (r[0], r[3], r[4], r[5]) for r in steps if r[1] == "wedge")
    stalls = sup.progress_stalls(df.filter("kind = 'check'"), ceiling=900).filter("stalled")
    assert sorted((r.entity, r.seq) for r in stalls.collect()) == sorted((r[0], r[3]) for r in steps if r[1] == "stall")
    paused = sup.pause_resurface(
        sup.pauses(df.filter("kind = 'log'"), entity="entity"), F.lit(rows[-1]["ts"]).cast("long"), 900)
    assert {(r.entity, r.at) for r in paused.collect()} >= {(r[0], r[2]) for r in steps if r[1] == "pause"}


@pytest.mark.parametrize("parts", [1, 7])
def test_open_decisions(spark, tmp_path, parts):
    rng = random.Random(parts)
    verbs = ["needs-decision", "blocked", "resolved", "captain-held", "done"]
    rows = [{"task": rng.randrange(3), "seq": i, "line": f"{rng.choice(verbs)} [key=k{rng.randrange(6)}]: n{i}"} for i in range(200)]
    schema = "task int, seq long, line string"
    lines = tx.parse_status(streamed(spark, tmp_path, rows, schema, parts))
    moves = str(tmp_path / "moves")
    jobs.run_batches(jobs.stream_open_decisions(lines), jobs.apply_moves(moves), str(tmp_path / "run"), "update")
    cols = ["task", "key", "seq", "verb", "note"]
    want = folds.open_decisions(tx.parse_status(spark.createDataFrame(rows, schema))).select(*cols)
    assert sorted(map(tuple, jobs.open_set(spark, moves, "int").select(*cols).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("parts", [1, 7])
def test_coalesced_signals(spark, tmp_path, parts):
    rng = random.Random(9)
    rows, ts = [], 1_700_000_000
    for i in range(150):
        ts += rng.choice([0, 3, 9, 50])
        rows.append({"home": rng.randrange(2), "ts": ts, "seq": i, "name": f"f{rng.randrange(3)}", "content": f"c{i}"})
    schema = "home int, ts long, seq long, name string, content string"
    got = jobs.run_to_table(
        jobs.coalesce_signals(streamed(spark, tmp_path, rows, schema, parts)), str(tmp_path / "run"))
    want = [r for r in model(rules.CoalesceSignals(), rows, "home", ts) if r[2] < ts]
    assert sorted((tuple(r) for r in got.collect() if r.ts < ts), key=str) == want
    opened = sup.batches(spark.createDataFrame(rows, schema), "home", "seq", "ts", 30)
    flushed = {(r[0], r[2] - 30) for r in model(rules.CoalesceSignals(), rows, "home", ts + 999)}
    assert {(r.home, r.opened_at) for r in opened.collect()} == flushed


def test_batched_escalations():
    rule, state = rules.BatchEscalations(), rules.BatchEscalations().fresh()
    rows = [{"ts": t, "seq": i, "kind": k, "item": f"i{i}"} for i, (t, k) in enumerate(
        [(0, "item"), (50, "item"), (89, "item"), (95, "item"), (100, "down"), (900, "up")])]
    out = keyed.replay(rule, state, rows, 2000)
    assert [(o[0], o[1], o[4]) for o in out] == [
        ("digest", 90, 3), ("alarm", 395, 1), ("alarm", 695, 1), ("digest", 900, 1)]
    assert out[0][5] == "i0 | i1 | i2"


def reply(*steps, until=10_000):
    rule, state = rules.Replies(), rules.Replies().fresh()
    rows = [{"ts": t, "seq": i, "kind": k, "text": x} for i, (t, k, x) in enumerate(steps)]
    return [(o[0], o[1], o[3]) for o in keyed.replay(rule, state, rows, until)]


def test_reply_ledger():
    opened = ("opened", 0, "awaiting_report")
    assert reply((0, "request", None), (5, "busy", None)) == [opened]
    assert reply((0, "request", None), (5, "report", "status")) == [opened, ("resolved", 5, "resolved")]
    assert reply((0, "request", None), (5, "idle", None)) == [opened, ("send", 120, "recovery_sending")]
    assert reply((0, "request", None), (500, "idle", None)) == [opened, ("send", 500, "recovery_sending")]
    lost = [(0, "request", None), (5, "idle", None), (130, "outcome", "confirmed"), (140, "busy", None), (150, "idle", None)]
    assert reply(*lost)[2:] == [("recovery", 130, "recovery_sent"), ("escalated", 150, "escalated")]
    assert reply(*lost, (160, "idle", None), (170, "report", "status"), (180, "report", "status"))[4:] == [
        ("resolved", 170, "resolved"), ("close", 170, "resolved")]
    failed = reply((0, "request", None), (5, "idle", None), (130, "outcome", "failed"), (150, "idle", None))
    assert failed[2:] == [("recovery", 130, "recovery_failed"), ("escalated", 130, "escalated")]


def test_late_rows_are_reported():
    rule = rules.AlertEdges("rising")
    rows = [{"ts": 5, "seq": 2, "over": True, "failed": False, "text": "", "to_status": ""},
            {"ts": 4, "seq": 1, "over": False, "failed": False, "text": "", "to_status": ""}]
    assert [o[:3] for o in keyed.replay(rule, rule.fresh(), rows, 0)] == [("rising", 5, 2), ("late", 4, 1)]


def test_consuming_a_batch_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    fn = jobs.consume_events({"too big": F.col("bytes") > 10}, out)
    first = spark.createDataFrame([("a", 1), ("b", 99), ("a", 1)], "event_id string, bytes int")
    second = spark.createDataFrame([("a", 1), ("c", 2)], "event_id string, bytes int")
    for batch, df in ((0, first), (0, first), (1, second), (1, second)):
        fn(df, batch)
    rows = lambda name: sorted((r.batch_id, r.event_id) for r in spark.read.parquet(f"{out}/{name}").collect())
    assert rows("accepted") == [(0, "a"), (1, "c")]
    assert rows("rejected") == [(0, "b")]


def test_append_once_and_wakes(spark, tmp_path):
    path = str(tmp_path / "once")
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "line string")
    for _ in range(2):
        ledgers.append_once(rows, path, ["line"])
    assert spark.read.parquet(path).count() == 2
    wakes = spark.createDataFrame([(1, "signal", "a\tb", "p"), (2, "odd", "k", "p"), (3, "check", "k", "x\ny")],
                                  "epoch long, kind string, key string, payload string").withColumn("place", F.col("epoch"))
    queue = str(tmp_path / "queue")
    for _ in range(2):
        ledgers.append_wakes(wakes, "place", queue)
    got = sorted((r.seq, r.key, r.payload) for r in spark.read.parquet(queue).collect())
    assert got == [(1, "a b", "p"), (2, "k", "x y"), (3, "a b", "p"), (4, "k", "x y")]
