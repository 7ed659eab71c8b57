"""Keyed streams over many small files out of time order."""

import random

import pytest

from tidelog.streaming import jobs, keyed, rules
from tidelog.vocab import Thresholds

LIMITS = Thresholds(stale_escalate=240, pause_resurface=900, progress_ceiling=900)
START = 1_700_000_000


def shuffled(spark, folder, rows, schema, files=6, seed=8):
    """Rows in no order over files that come one by one; the last file holds a row far ahead, which frees those that wait."""
    rows = rows[:-1]
    last = rows and rows[-1]
    random.Random(seed).shuffle(rows)
    step = -(-len(rows) // files)
    for n in range(0, len(rows), step):
        spark.createDataFrame(rows[n : n + step], schema).coalesce(1).write.mode("append").parquet(folder)
    ahead = dict(last, ts=START + 10_000_000, seq=999_999)
    spark.createDataFrame([ahead], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([dict(ahead, seq=1_000_000)], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def timed_rows(n, make, seed=3):
    rng, rows, ts = random.Random(seed), [], START
    for seq in range(n):
        ts += rng.choice([0, 1, 20, 60, 400])
        rows.append({"ts": ts, "seq": seq} | make(rng, seq))
    return rows


def in_order(rule, rows, key, until):
    out = []
    for k in sorted({r[key] for r in rows}):
        mine = [{c: r[c] for c in ("ts", "seq", *rule.columns)} for r in rows if r[key] == k]
        out += [(k, *o) for o in keyed.replay(rule, rule.fresh(), mine, until)]
    return sorted(out, key=str)


CASES = {
    "signals": (jobs.coalesce_signals, rules.CoalesceSignals(), "home", "home int, ts long, seq long, name string, content string",
                lambda r, i: {"home": r.randrange(2), "name": f"f{r.randrange(3)}", "content": f"c{i}"}, {}),
    "escalations": (jobs.batch_escalations, rules.BatchEscalations(), "channel", "channel int, ts long, seq long, kind string, item string",
                    lambda r, i: {"channel": r.randrange(2), "kind": r.choice(["item"] * 5 + ["down", "up"]), "item": f"i{i}"}, {}),
    "timers": (jobs.stream_timers, rules.Timers(limits=LIMITS), "entity",
               "entity int, ts long, seq long, kind string, hash long, busy boolean, phase string, token string, agent string, verb string",
               lambda r, i: {"entity": r.randrange(2), "kind": r.choice(["poll"] * 4 + ["check", "log"]), "hash": i // 60 % 2,
                             "busy": r.random() < 0.05, "phase": r.choice(["working"] * 5 + ["parked"]), "token": f"t{i // 90}",
                             "agent": "alive", "verb": r.choice(["paused", "working"])}, {"limits": LIMITS}),
    "busy": (jobs.stream_busy_state, rules.BusyState(), "task", "task int, ts long, seq long, kind string, gen string, gen_seq long, state string",
             lambda r, i: {"task": r.randrange(2), "kind": r.choice(["arm"] + ["event"] * 5), "gen": f"g{r.randrange(2)}", "gen_seq": i % 30,
                           "state": r.choice(["busy", "idle"])}, {}),
    "replies": (jobs.stream_replies, rules.Replies(), "corr", "corr int, ts long, seq long, kind string, text string",
                lambda r, i: {"corr": r.randrange(9), "kind": r.choice(["request", "busy", "idle", "idle", "outcome", "report"]),
                              "text": r.choice(["confirmed", "failed"])}, {}),
}


@pytest.mark.parametrize("case", CASES)
def test_files_in_any_order_give_the_ordered_result(spark, tmp_path, case):
    job, rule, key, schema, make, kw = CASES[case]
    rows = timed_rows(200, make)
    source = shuffled(spark, str(tmp_path / "in"), [*rows, rows[-1]], schema)
    out = jobs.run_to_table(job(source, key=key, delay="5 days", **kw), str(tmp_path / "out")).collect()
    top = rows[-1]["ts"]
    got = sorted((tuple(r) for r in out if r["ts"] <= top), key=str)
    assert got == [r for r in in_order(rule, rows, key, top) if r[2] <= top] and "late" not in {r[1] for r in got}


def test_reports_before_their_request(spark, tmp_path):
    rule = rules.Replies(wait=100)
    rows = [(0, "report", "early"), (10, "report", "again"), (50, "request", None), (60, "report", "late one")]
    replayed = lambda some, until: [(o[0], o[1], o[3], o[4]) for o in keyed.replay(
        rule, rule.fresh(), [{"ts": t, "seq": i, "kind": k, "text": x} for i, (t, k, x) in enumerate(some)], until)]
    assert replayed(rows, 1000) == [("opened", 50, "awaiting_report", None), ("resolved", 50, "resolved", "early")]
    assert replayed(rows[:2], 1000) == [("unmatched", 100, "unmatched", "2")]
    assert replayed(rows[:2], 99) == []
    assert replayed([*rows[:2], (150, "request", None)], 1000) == [
        ("unmatched", 100, "unmatched", "2"), ("opened", 150, "awaiting_report", None)]
    schema = "corr string, ts long, seq long, kind string, text string"
    files = [("a", START + 5, 1, "report", "r"), ("a", START, 0, "request", None), ("b", START + 7, 2, "report", "s"), ("c", START + 10_000, 3, "busy", None),
             ("c", START + 10_001, 4, "busy", None)]
    for row in files:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.run_to_table(jobs.stream_replies(source, delay="1 hour", wait=60), str(tmp_path / "out")).collect()
    assert sorted((r["corr"], r["kind"]) for r in out) == [("a", "opened"), ("a", "resolved"), ("b", "unmatched")]


@pytest.mark.parametrize("seed", range(3))
def test_offers_in_any_order(spark, tmp_path, seed):
    ttl, rng = 1000, random.Random(seed)
    rows = [{"request": f"r{rng.randrange(6)}", "ts": START + rng.randrange(6000), "seq": i} for i in range(240)]
    schema = "request string, ts long, seq long"
    for n in range(0, 240, 24):
        spark.createDataFrame(rows[n : n + 24], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.run_to_table(jobs.offer_once(source, ttl, "6000 seconds"), str(tmp_path / "out")).collect()
    assert sorted(r["seq"] for r in out) == list(range(240)) and {r["kind"] for r in out} == {"offer", "repeat"}
    for request in {r["request"] for r in rows}:
        offers = sorted(r["ts"] for r in out if r["request"] == request and r["kind"] == "offer")
        assert all(b - a >= ttl for a, b in zip(offers, offers[1:], strict=False))
        assert all(any(abs(r["ts"] - o) < ttl for o in offers) for r in rows if r["request"] == request)


def test_offers_too_late_to_tell_are_counted():
    rule = rules.OfferOnce(100)
    state = rule.fresh()
    row = lambda ts: [{"ts": ts, "seq": ts}]
    steps = [(1000, 1000), (1050, 1000), (1150, 1150), (960, 1150), (900, 1150), (2000, 2000), (1950, 2000), (1890, 2000)]
    assert [keyed.replay(rule, state, row(ts), mark)[0][0] for ts, mark in steps] == [
        "offer", "repeat", "offer", "repeat", "late", "offer", "repeat", "late"]


def test_rows_behind_the_watermark_reach_the_rule(spark, tmp_path):
    rows = [(f"e{k}", 100 * k + i, i, True, None, f"t{i}", None) for k in range(4) for i in range(10)]
    random.Random(4).shuffle(rows)
    schema = "entity string, ts long, seq long, over boolean, failed boolean, text string, to_status string"
    for n in range(0, len(rows), 5):
        spark.createDataFrame(rows[n : n + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.run_to_table(jobs.stream_alert_edges(source, "rising"), str(tmp_path / "out")).collect()
    seen, late, fired = {}, set(), set()
    for n in range(0, len(rows), 5):
        for r in sorted(rows[n : n + 5], key=lambda r: (r[1], r[2])):
            if r[1:3] < seen.get(r[0], (-1, -1)):
                late.add(r[:3])
                continue
            if r[0] not in seen:
                fired.add(r[:3])
            seen[r[0]] = r[1:3]
    assert late and {(r["entity"], r["ts"], r["seq"]) for r in out if r["kind"] == "late"} == late
    assert {(r["entity"], r["ts"], r["seq"]) for r in out if r["kind"] == "rising"} == fired
