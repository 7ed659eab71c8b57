"""Readers on small files."""

from tidelog.operators import folds
from tidelog.functions import text as tx
from tidelog.sources import backlog as bl
from tidelog.sources import ledgers, logs


def test_line_numbers_survive_splits(spark, tmp_path):
    for name, n in (("a", 500), ("b", 3), ("c", 1200)):
        (tmp_path / f"{name}.status").write_text("".join(f"working: {name} line {i}\n" + ("\n" if i % 50 == 0 else "") for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        rows = logs.read_status_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 1703
    for name in "abc":
        want = [(i + 1, line) for i, line in enumerate((tmp_path / f"{name}.status").read_text().split("\n")) if line]
        assert sorted((r.seq, r.line) for r in rows if r.task == name) == want


def test_kv_policies(spark, tmp_path):
    (tmp_path / "t1.meta").write_text("kind=ship\nhome=/a\nkind=scout\nnoise\nspawned=12\n")
    kv = logs.read_kv(spark, str(tmp_path))
    assert tuple(logs.pivot_kv(kv, ["kind", "home", "spawned"]).first()) == ("t1", "scout", "/a", "12")
    assert tuple(logs.pivot_kv(kv, ["kind", "home", "spawned"], "exactly_one").first()) == ("t1", None, "/a", "12")


BACKLOG = """- [ ] early - before any section
## In flight
- [ ] program - Aggregate program (repo: alpha) (kind: program)
- [ ] watch - Held observation (repo: alpha) (kind: scout) (hold: watch production) (hold-kind: external)
- [ ] worker - Real worker (repo: alpha) (kind: ship)
  first body line

    second body line

## Queued
- [ ] review - Security review (repo: alpha) (kind: ship)
* **bold one** - Bold title https://forge.example.com/a/pull/7 blocked-by: worker - needs it (since 2026-01-01)
- [ ] run - Run canary blocked-by: worker blocked-by: review (repo: alpha) (kind: captain) (hold: captain runs) (hold-kind: captain)
free text row
  indented under free text

## Notes
- [ ] worker - not a row

## Done
  indented after a foreign section
- [x] shipped - Shipped thing - data/shipped/report.md (merged 2026-02-03)
- [x] local - Local thing - local main (done 2026-02-04)
"""


def test_backlog(spark, tmp_path):
    path = tmp_path / "backlog.md"
    path.write_text(BACKLOG)
    rows, bodies = bl.read_backlog(spark, str(path))
    rows = bl.with_roles(rows)
    got = {r.id or r.raw.strip(): r for r in rows.collect()}
    assert set(got) == {"program", "watch", "worker", "review", "bold one", "run", "free text row",
                        "indented under free text", "indented after a foreign section", "shipped", "local"}
    assert [got[i].role for i in ("program", "watch", "worker", "review", "shipped")] == [
        "program", "held", "worker", "queued", "done"]
    assert got["worker"].body_excerpt == "first body line second body line"
    assert [r.text for r in bodies.orderBy("line_no").collect()] == ["first body line", "second body line"]
    bold = got["bold one"]
    assert (bold.title, bold.blocked_reason, bold.pr_url, bold.since) == (
        "Bold title", "needs it", "https://forge.example.com/a/pull/7", "2026-01-01")
    run = got["run"]
    assert (run.title, run.blocked_by, run.blocked_by_ids, run.unresolved, run.actionable) == (
        "Run canary", "review", ["worker", "review"], ["worker", "review"], False)
    shipped, local = got["shipped"], got["local"]
    assert (shipped.title, shipped.report_path, shipped.completion.verb, shipped.completion.date, shipped.checked) == (
        "Shipped thing", "data/shipped/report.md", "merged", "2026-02-03", True)
    assert (local.title, local.local_note) == ("Local thing", "local main")
    assert not got["free text row"].structured


def test_backlogs_of_several_files_keep_apart(spark, tmp_path):
    (tmp_path / "a.md").write_text("## Queued\n- [ ] run - Run blocked-by: dep (kind: ship)\n\n## Done\n- [x] dep - Dep\n")
    (tmp_path / "b.md").write_text("## Queued\n- [ ] run - Run blocked-by: dep (kind: ship)\n- [ ] dep - Dep\n")
    rows, _ = bl.read_backlog(spark, str(tmp_path))
    got = {r.file.rsplit("/", 1)[1]: r.unresolved for r in bl.with_roles(rows, ["file"]).filter("id = 'run'").collect()}
    assert got == {"a.md": [], "b.md": ["dep"]}


def test_registry(spark, tmp_path):
    path = tmp_path / "homes.md"
    path.write_text(
        "# Homes\n- ios - mobile (home: /h/ios; scope: app; projects: a; added 2026-01-01)\n"
        "- nas - remote (host: nas; root: /r; home: /h/nas; scope: infra; projects: b; added 2026-01-02)\n"
        "- ios - again (home: /h/two; scope: app; projects: a; added 2026-01-03)\n- odd - damaged\n")
    got = {r.id: r for r in bl.read_registry(spark, str(path)).collect()}
    assert (got["ios"].home, got["ios"].registry_error) == ("/h/ios", "duplicate home id in registry")
    assert (got["nas"].remote, got["nas"].host, got["nas"].home, got["nas"].registry_error) == (True, "nas", "/h/nas", None)
    assert got["odd"].registry_error == "registry entry has no home"


def test_timings_round_trip(spark, tmp_path):
    (tmp_path / "one.json").write_text(
        '{"run_id": "r", "selection": "lane", "summary": {"total": 2, "failed": 1, "skipped_gate": 0, "duration_ms": 9},\n'
        ' "scripts": [{"path": "a", "family": "f", "duration_ms": 5, "exit": 0, "gate_skip": false},\n'
        ' {"path": "b", "family": "f", "duration_ms": 4, "exit": 1, "gate_skip": true}]}\n')
    lanes, scripts = ledgers.read_timings(spark, str(tmp_path / "one.json"))
    assert (lanes.first().total, scripts.count()) == (2, 2)
    ledgers.write_timings(lanes, scripts, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/scripts")).count() == 2


def test_last_line_of_log(spark):
    df = spark.createDataFrame([("t", 1, "working: a"), ("t", 2, "paused: b"), ("t", 3, "   ")], "task string, seq long, line string")
    assert folds.latest_event(tx.parse_status(df)).first().verb == "paused"
