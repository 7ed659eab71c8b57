"""Backlog and registry text to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import joins, lineage, ordered
from tidelog.sources.logs import read_lines

# Section names and the shapes of structured rows.
SECTIONS = {"In flight": "in_flight", "Queued": "queued", "Done": "done"}
CHECK_ROW = r"^[-*]\s+\[([ xX])\]\s+(\S+)\s+-\s+(.*)$"
BOLD_ROW = r"^[-*]\s+\*\*([^*]+)\*\*\s+-\s+(.*)$"
TRAILING_METADATA = (
    r"(?:\s*\(\s*(?:(?:repo|kind|priority|hold|hold-kind):\s*[^)]*"
    r"|(?:since|merged|reported|done)\s+[^)]*)\s*\))+\s*$"
)
REPORT_PATH = r"data/[^\s)]+/report\.md"


def clean_title(col: Column) -> Column:
    out = F.regexp_replace(col, TRAILING_METADATA, "")
    for tail in (rf"\s+-\s+{REPORT_PATH}$", rf"\s+{REPORT_PATH}$", r"\s+-\s+local main$",
                 r"\s+local main$", r"\s+-\s*$"):
        out = F.regexp_replace(out, tail, "")
    return tx.trim_space(F.regexp_replace(out, r"\s+", " "))


def title_of(rest: Column) -> Column:
    out = F.regexp_replace(rest, f"<?{tx.URL}>?", "")
    out = F.regexp_replace(out, r"\s*blocked-by:\s+[^\s)]+\s+-\s+.*$", "")
    return clean_title(F.regexp_replace(out, r"\s*blocked-by:\s+\S+", ""))


def number_rows(lines: DataFrame, **kw) -> DataFrame:
    """Give each line its section and, for indented text, the row it belongs to.

    ``lines``: ``file, line_no, line``. The section, the last row and whether that row was
    structured are carried down a file as "last value seen", in two levels."""
    line = F.col("line")
    heading = line.rlike(r"^##\s+")
    name = tx.trim_space(F.regexp_replace(line, r"^##\s+", ""))
    section = F.lit("")
    for label, state in SECTIONS.items():
        section = F.when(name == label, state).otherwise(section)
    base = lines.withColumn("__head", F.when(heading, section))
    a = ordered.scan(base, ["file"], "line_no", last={"state": F.col("__head")}, **kw)
    inside = a.filter(F.col("__head").isNull() & (F.coalesce("state", F.lit("")) != "")
                      & (tx.trim_space(line) != ""))
    inside = lineage.cut(inside.select("file", "line_no", "line", "state"))
    shaped = inside.withColumn("structured", line.rlike(CHECK_ROW) | line.rlike(BOLD_ROW))
    indented = line.rlike(r"^\s+") & ~F.col("structured")
    # An indented line belongs to the row above when that row is structured; else it is a row of
    # its own, so only lines that cannot be a body decide what "the row above" is.
    b = shaped.withColumn("__row", F.when(~indented, F.struct("line_no", "structured")))
    c = ordered.scan(b, ["file"], "line_no", last={"__above": F.col("__row")}, **kw)
    body_of = F.when(indented & F.col("__above.structured"), F.col("__above.line_no"))
    return lineage.cut(c.select("file", "line_no", "line", "state", "structured", body_of.alias("body_of")))


def parse_backlog(lines: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Backlog rows and their body lines.

    Rows: ``file, seq, state, structured, id, checked, title, repo, kind, priority, hold_reason,
    hold_kind, blocked_by, blocked_by_ids, blocked_reason, since, completion, links, pr_url,
    report_path, local_note, raw, body_excerpt``. Bodies: ``file, seq, line_no, text`` with the
    ``seq`` of their row.

    An indented line directly after an unstructured row starts a row of its own, and so does every
    indented line after that one, until the next unindented line."""
    numbered = number_rows(lines, **kw)
    bodies = numbered.filter("body_of IS NOT NULL").select(
        "file", F.col("body_of").alias("seq"), "line_no", tx.trim_space(F.col("line")).alias("text"))
    line = F.col("line")
    check = line.rlike(CHECK_ROW)
    ident = F.when(check, F.regexp_extract(line, CHECK_ROW, 2)).otherwise(
        tx.trim_space(F.regexp_extract(line, BOLD_ROW, 1)))
    rest_text = F.when(check, F.regexp_extract(line, CHECK_ROW, 3)).otherwise(
        F.regexp_extract(line, BOLD_ROW, 2))
    structured = F.col("structured")
    heads = numbered.filter("body_of IS NULL").select(
        "file", F.col("line_no").alias("seq"), "state", "structured", F.col("line").alias("line"))
    rows = tx.computed(
        heads,
        id=F.when(structured, ident),
        checked=F.when(structured, F.lower(F.regexp_extract(line, CHECK_ROW, 1)) == "x"),
        rest=F.when(structured, rest_text),
    ).withColumnRenamed("line", "raw")
    rest = F.col("rest")
    ids = F.array_distinct(F.regexp_extract_all(rest, F.lit(r"blocked-by:\s+([^\s)]+)"), 1))
    reason = clean_title(tx.capture(rest, r"^.*blocked-by:\s*[^\s)]+\s+-\s*(.*)$"))
    bare = F.regexp_replace(rest, TRAILING_METADATA, "")
    words = {w: tx.extract_meta_word(rest, w) for w in ("merged", "reported", "done")}
    verb = F.coalesce(*[F.when(v.isNotNull(), F.lit(w)) for w, v in words.items()])
    links = tx.extract_links(rest)
    # The excerpt is the first 240 characters, so the lines past them are not needed: a running
    # length keeps the gathered prefix short whatever the body's length.
    sized = ordered.scan(
        bodies, ["file", "seq"], "line_no", total={"__len": F.length("text") + 1}, **kw)
    lead = sized.filter(F.col("__len") - F.length("text") - 1 < 240).groupBy("file", "seq").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("lead"))
    excerpt = F.substring(F.array_join(F.transform("lead", lambda s: s["text"]), " "), 1, 240)
    out = rows.join(lead, ["file", "seq"], "left").select(
        "file", "seq", "state", "structured", "id", "checked",
        title_of(rest).alias("title"),
        tx.extract_meta(rest, "repo").alias("repo"),
        tx.extract_meta(rest, "kind").alias("kind"),
        tx.extract_meta(rest, "priority").alias("priority"),
        tx.extract_meta(rest, "hold").alias("hold_reason"),
        tx.extract_meta(rest, "hold-kind").alias("hold_kind"),
        tx.capture(rest, r"^.*blocked-by:\s*([^\s)]+)").alias("blocked_by"),
        ids.alias("blocked_by_ids"),
        F.when(reason != "", reason).alias("blocked_reason"),
        tx.extract_meta_word(rest, "since").alias("since"),
        F.struct(verb.alias("verb"), F.coalesce(*words.values()).alias("date")).alias("completion"),
        links.alias("links"),
        tx.first_change_link(links).alias("pr_url"),
        tx.capture(rest, rf"^.*({REPORT_PATH})").alias("report_path"),
        tx.capture(bare, r"(?:^|\s)(local main)$").alias("local_note"),
        "raw",
        excerpt.alias("body_excerpt"),
    )
    return out, bodies


def read_backlog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and body lines of backlog files; one home per file."""
    return parse_backlog(read_lines(spark, path))


def with_roles(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Add ``unresolved``, ``role``, ``requires_child`` and ``actionable`` to structured rows.

    ``scope`` names the columns that tell several backlogs apart, ``["file"]`` for rows read from
    many files; without it, ``seq`` must be unique over all rows and ids are shared."""
    open_ids = joins.open_blockers_by_row(rows, scope)
    held = F.col("hold_reason").isNotNull() & F.col("hold_kind").isNotNull()
    in_flight = F.col("state") == "in_flight"
    role = (
        F.when(in_flight & held, "held")
        .when(in_flight & (F.col("kind") == "program"), "program")
        .when(in_flight, "worker")
        .when(F.col("state") == "queued", "queued")
        .otherwise("done")
    )
    none = F.slice("blocked_by_ids", 1, 0)
    marked = (
        rows.join(open_ids, [*scope, "seq"], "left")
        .withColumn("unresolved", F.when(F.col("structured"), F.coalesce("unresolved", none)))
        .withColumn("role", F.when(F.col("structured"), role))
    )
    captain = (F.col("kind") == "captain") & (F.col("hold_kind") == "captain")
    ready = (F.col("state") == "queued") & captain & F.col("hold_reason").isNotNull() & (F.size("unresolved") == 0)
    return marked.withColumn("requires_child", F.coalesce(F.col("role") == "worker", F.lit(False))).withColumn(
        "actionable", F.coalesce(ready, F.lit(False)))


# --- registry --------------------------------------------------------------------------------

# The two shapes of a registry line.
LOCAL_LINE = (
    r"^- ([A-Za-z0-9._-]+) - (.+) \(home:\s*([^;)]*);\s*scope:\s*(.*);\s*projects:\s*([^;)]*);"
    r"\s*added\s+([0-9]{4}-[0-9]{2}-[0-9]{2})\)\s*$"
)
REMOTE_LINE = (
    r"^- ([A-Za-z0-9._-]+) - (.+) \(host:\s*([^;)]*);\s*root:\s*([^;)]*);\s*home:\s*([^;)]*);"
    r"\s*scope:\s*(.*);\s*projects:\s*([^;)]*);\s*added\s+([0-9]{4}-[0-9]{2}-[0-9]{2})\)\s*$"
)


def parse_registry(lines: DataFrame) -> DataFrame:
    """Registry entries: ``id, summary, home, host, root, scope, projects, added, remote,
    registry_error``. The local shape is tried first; of a repeated id the first line stays and
    carries an error. ``lines``: ``line_no, line``."""
    line = F.col("line")
    local, remote = line.rlike(LOCAL_LINE), line.rlike(REMOTE_LINE)

    def field(l_group: int | None, r_group: int) -> Column:
        far = F.when(~local & remote, F.regexp_extract(line, REMOTE_LINE, r_group))
        return far if l_group is None else F.when(local, F.regexp_extract(line, LOCAL_LINE, l_group)).otherwise(far)

    parsed = lines.withColumn("id", F.regexp_extract(line, r"^- (\S+)", 1)).filter("id <> ''").select(
        "line_no", "id",
        field(2, 2).alias("summary"), field(3, 5).alias("home"), field(None, 3).alias("host"),
        field(None, 4).alias("root"), field(4, 6).alias("scope"), field(5, 7).alias("projects"),
        field(6, 8).alias("added"), (~local & remote).alias("remote"),
    )
    cols = ["line_no", "summary", "home", "host", "root", "scope", "projects", "added", "remote"]
    first = F.min_by(F.struct(*cols), F.col("line_no")).alias("r")
    error = F.when(F.col("n") > 1, "duplicate home id in registry").when(
        F.coalesce("home", F.lit("")) == "", "registry entry has no home")
    return parsed.groupBy("id").agg(first, F.count("*").alias("n")).select(
        "id", "n", *[F.col(f"r.{c}").alias(c) for c in cols]
    ).withColumn("registry_error", error).drop("n", "line_no")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry(read_lines(spark, path))
