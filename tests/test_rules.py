"""Operators against sequential models of their rules on seeded random rows. Chunks are kept tiny,
so that every carry between chunks is exercised."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import anchored, audits, corpus, folds, joins, ordered, ranking, sets
from tidelog.operators import suppression as sup
from tidelog.sources import ledgers

TINY = {"chunk_bits": 2}


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def events(seed, n=400, entities=4, hot=0.6):
    """Events of which one entity holds more than half."""
    rng = random.Random(seed)
    out, ts = [], 0
    for seq in range(n):
        ts += rng.choice([0, 0, 1, 5, 40, 300])
        entity = 0 if rng.random() < hot else rng.randrange(1, entities)
        out.append((entity, seq, ts, rng.randrange(1000)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scan(spark, seed):
    data = events(seed)
    df = spark.createDataFrame(data, "e int, seq long, ts long, v int")
    got = ordered.scan(
        df, ["e"], "seq", previous={"p": F.col("v")},
        last={"l": F.when(F.col("v") % 3 == 0, F.col("v"))}, total={"t": F.col("v")}, **TINY)
    state, want = {}, []
    for e, seq, _, v in data:
        p, last, total = state.get(e, (None, None, 0))
        want.append((e, seq, p, last, total + v))
        state[e] = (v, v if v % 3 == 0 else last, total + v)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.select("e", "seq", "p", "l", "t").collect()), key=key) == sorted(want, key=key)


def test_global_rank(spark):
    df = spark.createDataFrame([(s * 7,) for s in range(100)], "seq long")
    assert rows_of(ordered.rank(df, [], "seq", **TINY), "seq", "rn") == [(i * 7, i + 1) for i in range(100)]


VERBS = ["needs-decision", "blocked", "resolved", "captain-held", "working", "paused", "done", "failed"]


def status_lines(seed, n=500):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        key = rng.choice(["", " [key=a]", " [key=b]", " [key=pending-reply-1]", " [key=b d]", " [key=]"])
        note = rng.choice(["note", "pending-reply-missed: x", "pending-reply-x no colon", "a: b"])
        stamp = rng.choice(["", "2026-01-02T03:04:05Z ", "[2026-01-02] ", "2026-01-02x "])
        out.append((rng.randrange(3), seq, f"{stamp}{rng.choice(VERBS)}{key}: {note}"))
    return out


def fold_loop(lines, openers, closers, guard):
    opened = {}
    for task, seq, line in lines:
        if line.startswith("2026-01-02x"):
            continue
        text = line.split("] ", 1)[1] if line.startswith("[20") else line.split("Z ", 1)[-1]
        head, note = text.split(":", 1)
        verb, _, token = head.partition(" [key=")
        key = token.rstrip("]") if token else "default"
        if token and not key.replace("-", "").isalnum():
            continue
        note = note.strip()
        if guard and key.startswith("pending-reply-"):
            if not (note.startswith("pending-reply-") and ":" in note):
                continue
        if verb in openers:
            opened.pop((task, key), None)
            opened[(task, key)] = (seq, verb, note)
        elif verb in closers:
            opened.pop((task, key), None)
    return sorted((t, k, *v) for (t, k), v in opened.items())


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_open_sets(spark, seed):
    lines = status_lines(seed)
    parsed = tx.parse_status(spark.createDataFrame(lines, "task int, seq long, line string"))
    cols = ("task", "key", "seq", "verb", "note")
    assert rows_of(folds.open_decisions(parsed), *cols) == fold_loop(
        lines, {"needs-decision", "blocked"}, {"resolved", "captain-held"}, True)
    assert rows_of(folds.open_activities(parsed), *cols) == fold_loop(
        lines, {"working", "paused"}, {"done", "failed", "needs-decision", "blocked", "resolved", "captain-held"}, False)


def test_reserved_key_is_owned_by_its_namespace(spark):
    lines = [
        (1, "blocked [key=pending-reply-ab]: pending-reply-missed: task=ios"),
        (2, "blocked [key=pending-reply-ab]: shipping is blocked on infra"),
        (3, "resolved [key=pending-reply-ab]: all good now"),
    ]
    df = tx.parse_status(spark.createDataFrame([("t", *x) for x in lines], "task string, seq long, line string"))
    assert [r.note for r in folds.open_decisions(df).collect()] == ["pending-reply-missed: task=ios"]
    closed = df.unionByName(tx.parse_status(spark.createDataFrame(
        [("t", 4, "resolved [key=pending-reply-ab]: pending-reply-resolved: via=status")], "task string, seq long, line string")))
    assert folds.open_decisions(closed).count() == 0


def test_dedupe_wakes(spark):
    rows = [(1, 1, "heartbeat", "heartbeat", "h"), (2, 2, "signal", "task.status", "a"),
            (3, 3, "heartbeat", "other", "h2"), (4, 4, "signal", "task.status", "b")]
    got = folds.dedupe_wakes(spark.createDataFrame(rows, "epoch long, seq long, kind string, key string, payload string"))
    assert rows_of(got, "first_seq", "seq", "payload") == [(1, 3, "h2"), (2, 4, "b")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fit_budget(spark, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(3), i, rng.choice([1, 2, 3, 7, 20, 33, 90])) for i in range(300)]
    used, want = {}, []
    for g, i, size in data:
        if used.get(g, 0) + size <= 100:
            used[g] = used.get(g, 0) + size
            want.append((g, i))
    df = spark.createDataFrame(data, "g int, seq long, size int")
    assert rows_of(ranking.fit_budget(df, ["g"], "seq", "size", 120, reserve=20, **TINY), "g", "seq") == sorted(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lpt(spark, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(3), f"script-{i:03d}-{rng.randrange(9)}", rng.choice([None, 0, 1, 2, 5, 5, 5, 300])) for i in range(200)]
    want = []
    for g in range(3):
        loads = [0] * 4
        items = sorted(((7 if w is None else w, n) for gg, n, w in data if gg == g), key=lambda x: (-x[0], x[1]))
        for w, name in items:
            best = loads.index(min(loads))
            loads[best] += w
            want.append((g, name, best + 1))
    df = spark.createDataFrame(data, "g int, name string, w int")
    assert rows_of(ranking.lpt_assign(df, ["g"], "name", "w", 4, 7), "g", "name", "bin") == sorted(want)


@pytest.mark.parametrize("seed,limit_bytes", [(1, 60), (2, 100), (3, 10000)])
def test_bounded_tail(spark, seed, limit_bytes):
    rng = random.Random(seed)
    logs = {g: ["x" * rng.randrange(1, 12) for _ in range(rng.randrange(3, 20))] for g in range(4)}
    want, reasons = [], []
    for g, lines in logs.items():
        blob = "".join(line + "\n" for line in lines)
        tail = blob[-limit_bytes:]
        if len(blob) > limit_bytes:
            tail = tail.split("\n", 1)[1]
        kept = tail.split("\n")[:-1]
        reasons.append((g, len(blob) > limit_bytes, len(kept) > 5))
        kept = kept[-5:]
        start = len(lines) - len(kept)
        want += [(g, start + i, line) for i, line in enumerate(kept)]
    df = spark.createDataFrame([(g, i, x) for g, ls in logs.items() for i, x in enumerate(ls)], "g int, seq long, line string")
    kept, why = ranking.bounded_tail(df, ["g"], "seq", "line", 5, limit_bytes)
    assert rows_of(kept, "g", "seq", "line") == sorted(want)
    assert rows_of(why, "g", "byte_limit", "line_limit") == sorted(reasons)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_edges(spark, seed):
    data = events(seed)
    df = spark.createDataFrame(data, "e int, seq long, ts long, v int")
    over, want = {}, []
    for e, seq, _, v in data:
        if v >= 500 and not over.get(e):
            want.append((e, seq))
        over[e] = v >= 500
    assert rows_of(sup.rising_edges(df, "e", "seq", F.col("v") >= 500, **TINY), "e", "seq") == sorted(want)

    status = {0: "blocked", 1: "working", 2: "idle", 3: "done", 4: "unknown"}
    marked, want = set(), []
    for e, seq, _, v in data:
        to = status[v % 5]
        if to == "blocked" and e not in marked:
            marked.add(e)
            want.append((e, seq))
        elif to == "working":
            marked.discard(e)
    names = F.create_map(*[F.lit(x) for kv in status.items() for x in kv])
    edges = df.withColumn("to_status", names[F.col("v") % 5])
    assert rows_of(sup.fresh_edges(edges, "e", "seq", **TINY), "e", "seq") == sorted(want)

    texts = ["2026-01-01T00:00:00 FAILED: a", "2026-01-02T00:00:00 FAILED: a", "FAILED: b", "ok", "", "ALERT", "ALERTS"]
    mark, want = {}, []
    for e, seq, _, v in data:
        line = texts[v % 7]
        if not line:
            continue
        if "FAILED" in line or line == "ALERT":
            bare = line.split("00 ", 1)[-1]
            if mark.get(e) != bare:
                want.append((e, seq))
            mark[e] = bare
        else:
            mark.pop(e, None)
    lines = df.withColumn("line", F.array(*[F.lit(t) for t in texts])[F.col("v") % 7])
    assert rows_of(sup.alert_changes(lines, "e", "seq", **TINY), "e", "seq") == sorted(want)


def wedge_loop(rows, secs, demand):
    """(entity, seq, ts, hash, busy) in order -> escalations."""
    state, out = {}, []
    for e, seq, ts, h, busy in rows:
        s = state.setdefault(e, {"h": None, "n": 0, "since": None, "count": 0})
        s["n"] = s["n"] + 1 if h == s["h"] else 0
        s["h"] = h
        if s["n"] < 2 or busy:
            s["since"], s["count"] = None, 0
        elif s["since"] is None:
            s["since"] = ts
        elif ts - s["since"] >= secs:
            s["count"] += 1
            out.append((e, seq, s["count"], ts - s["since"], s["count"] >= demand))
            s["since"] = None
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_wedge_escalations(spark, seed):
    rng = random.Random(seed)
    data = [(e, seq, ts, (seq // rng.choice([15, 40])) % 2, rng.random() < 0.05) for e, seq, ts, _ in events(seed, 600)]
    df = spark.createDataFrame(data, "entity int, seq long, ts long, hash long, busy boolean")
    stale = sup.stale_polls(df, **TINY)
    cols = ("entity", "seq", "n", "elapsed")
    for bits in (7, 9, 20):
        fired = anchored.chain(stale, "entity", "stretch", "seq", "ts", 240, restart="next", chunk_bits=bits)
        assert rows_of(fired, *cols) == [r[:4] for r in wedge_loop(data, 240, 3)]
    got = rows_of(sup.wedge_escalations(df, **TINY), "entity", "seq", "escalation", "idle_secs", "demand_inspect")
    assert got == wedge_loop(data, 240, 3)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("restart", ["same", "next"])
def test_chain(spark, seed, restart):
    rng = random.Random(seed)
    data, episode = [], 0
    for e, seq, ts, _ in events(seed, 500):
        episode += rng.random() < 0.02
        data.append((e, episode, seq, ts))
    state, want = {}, []
    for e, ep, seq, ts in data:
        s = state.get(e)
        if s is None or s[0] != ep:
            state[e] = [ep, ts, 0]
        elif s[1] is None:
            s[1] = ts
        elif ts - s[1] >= 100:
            s[2] += 1
            want.append((e, ep, seq, s[2], ts - s[1]))
            s[1] = ts if restart == "same" else None
    df = spark.createDataFrame(data, "e int, ep long, seq long, ts long")
    for bits in (5, 8, 20):
        got = anchored.chain(df, "e", "ep", "seq", "ts", 100, restart=restart, chunk_bits=bits)
        assert rows_of(got, "e", "ep", "seq", "n", "elapsed") == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_idle_anchor(spark, seed):
    rng = random.Random(seed)
    data, state, want = [], {}, []
    for e, seq, ts, _ in events(seed):
        now = max(ts - rng.choice([0, 0, 0, 500, 5000]), 0)
        verdict = rng.choice(["busy", "busy", "unknown", "idle"])
        data.append((e, seq, now, verdict))
        rec = state.get(e)
        if verdict == "idle":
            state[e] = (now, now)
        elif rec:
            anchor, last = rec
            if now < last:
                anchor = max(anchor - (last - now), 0)
            state[e] = (anchor, now)
        want.append((e, seq, state[e][0] if e in state else None))
    df = spark.createDataFrame(data, "entity int, seq long, ts long, state string")
    got = sorted(map(tuple, sup.idle_anchor(df, **TINY).select("entity", "seq", "anchor").collect()), key=lambda r: r[:2])
    assert got == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize("seed", [1, 2])
def test_progress_stalls(spark, seed):
    rng = random.Random(seed)
    data, mark, want = [], {}, []
    for e, seq, ts, _ in events(seed, 600):
        phase, token = rng.choice(["working"] * 6 + ["done", "parked"]), f"t{seq // 80 % 3}"
        agent = "dead" if rng.random() < 0.05 else "alive"
        data.append((e, seq, ts, phase, token, agent))
        if phase not in ("working", "done") or (agent == "dead" and phase != "done"):
            want.append((e, seq, "escalate"))
            continue
        if e not in mark or mark[e][1] != token:
            mark[e] = (ts, token)
            want.append((e, seq, "defer"))
        elif ts - mark[e][0] >= 900:
            mark[e] = (ts, token)
            want.append((e, seq, "escalate"))
        else:
            want.append((e, seq, "defer"))
    df = spark.createDataFrame(data, "entity int, seq long, ts long, phase string, token string, agent string")
    assert rows_of(sup.progress_stalls(df, ceiling=900, **TINY), "entity", "seq", "verdict") == sorted(want)


def test_suppress_paused(spark):
    logs = spark.createDataFrame([(1, 2, "paused"), (1, 6, "working"), (2, 1, "working")], "e int, seq long, verb string")
    edges = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (1, 7), (2, 9), (3, 4)], "e int, seq long")
    assert rows_of(sup.suppress_paused(edges, logs, "e", "seq", **TINY), "e", "seq", "absorbed") == [
        (1, 1, False), (1, 2, True), (1, 5, True), (1, 7, False), (2, 9, False), (3, 4, False)]


def test_blockers_last_record_wins(spark):
    rows = spark.createDataFrame([
        (1, "worker", "done", True, []), (2, "worker", "queued", True, []), (3, "review", "queued", True, []),
        (4, "review", "done", True, []), (5, "run", "queued", True, ["worker", "review", "missing", "worker"]),
    ], "seq long, id string, state string, structured boolean, blocked_by_ids array<string>")
    got = {r.id: r.unresolved for r in joins.unresolved_blockers(rows).filter("seq = 5").collect()}
    assert got == {"run": ["worker", "missing"]}


@pytest.mark.parametrize("quota,expect", [
    ([("fresh", 80, 30), ("fresh", 70, 60)], "b"),
    ([("fresh", 90, 50), ("fresh", 60, 50)], "a"),
    ([("stale", 85, 70), ("fresh", 65, 60)], "b"),
    ([("stale", 90, 85), ("fresh", 65, 60)], "a"),
    ([None, ("fresh", 40, 50)], "b"),
    ([None, None], "a"),
])
def test_quota_choice(spark, quota, expect):
    rows = [(v, q[0], w, "session", q[1 + w]) for v, q in zip("ab", quota, strict=True) if q for w in (0, 1)]
    q = spark.createDataFrame(rows, "vendor string, status string, window_id int, kind string, remaining int")
    windows = spark.createDataFrame([(v, w) for v in "ab" for w in (0, 1)], "vendor string, window_id int")
    requests = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b")], "request string, idx int, vendor string")
    got = ranking.quota_choice(requests, q, windows).first()
    assert (got.vendor, got.fallback) == (expect, quota == [None, None])


def test_set_signature_follows_the_set(spark):
    def sig(*members):
        df = spark.createDataFrame([("g", m) for m in members], "g string, m string")
        return folds.set_signature(df, ["g"], "m").first().signature

    assert sig("a", "b") == sig("b", "a", "b") != sig("a", "c")


def test_continuity_detects_reordering(spark):
    old = spark.createDataFrame([("l", 1, "a"), ("l", 2, "b")], "log string, seq long, line string")
    swapped = spark.createDataFrame([("l", 1, "b"), ("l", 2, "a"), ("l", 3, "c")], "log string, seq long, line string")
    grown = spark.createDataFrame([("l", 1, "a"), ("l", 2, "b"), ("l", 3, "cc"), ("l", 4, "dd")], "log string, seq long, line string")
    cursor = ledgers.log_digest(old)
    assert ledgers.audit_continuity(cursor, swapped, 99).first().status == "prefix-changed"
    assert tuple(ledgers.audit_continuity(cursor, grown, 4, **TINY).first()) == ("l", "delta", 1, 3)
    assert ledgers.audit_continuity(cursor, grown, 2).first().status == "line-exceeds-bound"


def test_partition_audit(spark):
    parts = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "b"), ("s2", "x"), ("s2", "x")], "shard string, item string")
    inventory = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    shards = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "shard string")
    assert rows_of(sets.partition_audit(parts, inventory, shards), "violation", "subject") == [
        ("duplicate", "x"), ("empty", "s3"), ("extra", "x"), ("missing", "c"), ("overlap", "b")]


def test_overlapping_paths(spark):
    df = spark.createDataFrame(
        [("/a", "1"), ("/a/b/c", "2"), ("/ab", "3"), ("/x", "4"), ("/x", "5"), ("/y", "4")], "path string, id string")
    assert sorted((r.kind, r.path, r.other or "", r.n) for r in audits.overlapping_paths(df).collect()) == [
        ("contained", "/a", "/a/b/c", 2), ("duplicate-id", "/x", "", 2), ("duplicate-path", "/x", "", 2)]


@pytest.mark.parametrize("text,expect", [
    ("Rotate the session token whenever privileges change.", "session token"),
    ("Expire the session after an hour of inactivity.", "expire session"),
    ("Reuse the same session id for every lookup.", "session id"),
    ("Consider relocating the uid guard.", "uid guard"),
    ("Reuse the same session for every lookup in the batch.", ""),
    ("Run the guard check at every session start.", ""),
    ("Print the identity-platform authorize URL.", "identity platform,platform authorize"),
])
def test_pairs(spark, text, expect):
    df = spark.createDataFrame([(1, 0, text)], "doc_id int, clause_no int, text string")
    assert ",".join(sorted({r.pair for r in corpus.pair_hits(df).collect()})) == expect


def test_links(spark):
    pages = spark.createDataFrame([
        ("a/x.md", "# One\n## One\n[ok](y.md#two) [bad](y.md#three) [self](#one-1) [no](#one-2) [abs](/z) [up](../../q.md)"),
        ("a/y.md", "## Two ##\n[web](https://e.com) [gone](<z w.md> \"t\")"),
    ], "path string, text string")
    inventory = spark.createDataFrame([("a/x.md", "all"), ("a/x.md", "some"), ("b.md", "all")], "path string, audience string")
    assert rows_of(audits.audit_links(pages, inventory), "kind", "path", "subject") == [
        ("absolute", "a/x.md", "/z"), ("duplicate", "a/x.md", "a/x.md"), ("escapes", "a/x.md", "../../q.md"),
        ("extra", "b.md", "b.md"), ("unclassified", "a/y.md", "a/y.md"),
        ("unresolved-anchor", "a/x.md", "#one-2"), ("unresolved-anchor", "a/x.md", "y.md#three"),
        ("unresolved-link", "a/y.md", "<z w.md> \"t\"")]


def test_names_are_found_anywhere_in_a_text(spark):
    from tidelog.operators import audits

    names = spark.createDataFrame([("ab-x.sh",), ("x.sh",), ("q",), ("",)], "name string")
    texts = spark.createDataFrame(
        [(1, "see ab-x.sh."), (2, "my-ab-x.sh"), (3, "x_sh\nab-x"), (4, None), (5, "q")], "test long, text string")
    got = sorted((r["name"], r["test"]) for r in audits.tests_referencing(names, texts).collect())
    assert got == [("ab-x.sh", 1), ("ab-x.sh", 2), ("q", 5), ("x.sh", 1), ("x.sh", 2)]


def test_a_stray_percent_sign_in_a_link_is_itself(spark):
    from tidelog.operators import audits

    pages = spark.createDataFrame([("a.md", "[x](b.md#50%off) [y](b.md#a%20b+c)")], "path string, text string")
    assert sorted(r["fragment"] for r in audits.page_links(pages).collect()) == ["50%off", "a b+c"]


def test_terminal_events_are_judged_before_repeats_go(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidelog.streaming import jobs

    rows = [("e1", -1), ("e1", 5), ("e2", 7), ("e2", 7), ("e3", -2)]
    df = spark.createDataFrame(rows, "event_id string, size int")
    jobs.consume_events({"size": F.col("size") < 0}, str(tmp_path))(df, 0)
    accepted = sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/accepted").collect())
    refused = sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/rejected").collect())
    assert accepted == ["e1", "e2"] and refused == ["e1", "e3"]


def test_backlogs_of_two_homes_do_not_mix(spark):
    from tidelog.operators import joins
    from tidelog.sources.backlog import with_roles

    rows = spark.createDataFrame(
        [("h1", 1, "a", "queued", ["zz"]), ("h2", 1, "a", "done", []), ("h2", 2, "zz", "done", [])],
        "home string, seq long, id string, state string, blocked_by_ids array<string>",
    ).selectExpr("*", "true AS structured", "'ship' AS kind", "cast(null AS string) AS hold_reason", "cast(null AS string) AS hold_kind")
    got = {(r["home"], r["id"]): r["unresolved"] for r in with_roles(rows, ["home"]).collect()}
    assert got == {("h1", "a"): ["zz"], ("h2", "a"): [], ("h2", "zz"): []}
    tasks = spark.createDataFrame([("h1", "a"), ("h2", "a"), ("h3", "a")], "home string, id string")
    attached = joins.attach_backlog(tasks, rows.select("home", "id", "seq", "structured", "state"), ["home"])
    assert {r["home"]: r["backlog_state"] for r in attached.collect()} == {"h1": "queued", "h2": "done", "h3": None}


def test_busy_record_faults(spark):
    ok = "v1 gen=g.1 seq=3 state=busy source=main-hook event=turn_start ts=17\n"
    cases = {
        ok: None, "garbage\n": "version", ok.replace("v1", "v0"): "version", ok.replace("seq=3", "seq=NaN"): "seq",
        ok.replace("busy", "frobbing"): "state", ok.replace("main-hook", "bad source"): "unknown-field", ok.replace("\n", " rogue=1\n"): "unknown-field",
        ok + "second line\n": "lines", ok.rstrip(): "lines", "": "lines", None: "lines", ok.replace(" event=turn_start", ""): "event",
        ok.replace("gen=g.1", "gen="): "gen", ok.replace("ts=17", "ts=-1"): "ts", " " + ok.replace(" ", "   "): None, ok + "tail": None,
        ok.replace("\n", " state=idle\n"): None,
    }
    records = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(cases)], "task string, seq long, record string")
    got = {r["seq"]: r for r in folds.read_busy(records).collect()}
    assert [got[i]["fault"] for i in range(len(cases))] == list(cases.values())
    assert tuple(got[0])[2:8] == ("g.1", "3", "busy", "main-hook", "turn_start", "17") and got[len(cases) - 1]["state"] == "idle"
    assert all(got[i]["gen"] is None for i, fault in enumerate(cases.values()) if fault)
    armed = spark.createDataFrame([(str(i), "g.1", "main") for i in range(len(cases))], "task string, gen string, producer string")
    trust = spark.createDataFrame([("main", "main-hook")], "producer string, source string")
    states = {r["task"]: (r["state"], r["source"]) for r in folds.current_busy(folds.read_busy(records), armed, trust).collect()}
    assert [states[str(i)][1] == "malformed" for i in range(len(cases))] == [f is not None for f in cases.values()]


def test_names_of_one_prefix_meet_few_texts(spark, monkeypatch):
    import random

    from tidelog.operators import audits

    rng = random.Random(1)
    names = [f"fm-{rng.randrange(16 ** 6):06x}" for _ in range(500)] + ["ab", "x", "né☃", ""]
    texts = [" ".join([*(f"fm-{rng.randrange(16 ** 6):06x}" for _ in range(30)), rng.choice(names)]) for _ in range(200)]
    frames = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(texts)), "test int, text string")
    out = audits.tests_referencing(*frames)
    assert {tuple(r) for r in out.collect()} == {(n, i) for n in names for i, t in enumerate(texts) if n and n in t}
    tried = []
    join = type(out).join
    monkeypatch.setattr(type(out), "join", lambda self, other, on=None, how=None: (
        tried.append(self.count()) if on == "test" else None, join(self, other, on, how))[1])
    found = audits.tests_referencing(*frames).count()
    assert tried[0] < 10 * found < 4000
