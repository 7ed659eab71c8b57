"""Table audits: change links, traces, message kinds, path risk, ceilings, references and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import lineage
from tidelog.vocab import MESSAGE_KINDS

# Accepted shapes of change links.
PULL_URL = (
    r"^https://github\.com/([A-Za-z0-9]|[A-Za-z0-9][A-Za-z0-9-]{0,37}[A-Za-z0-9])"
    r"/([A-Za-z0-9._-]{1,100})/pull/([1-9][0-9]*)$"
)
MERGE_URL = r"^https://([a-z0-9.-]{1,253})/([A-Za-z0-9._/-]+)/-/merge_requests/([1-9][0-9]*)$"
TRACE = r"^00-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$"

# Words that make a changed path risky. Weak words count only as a whole component.
STRONG_PATH_WORDS = (
    "auth|authn|authz|authoriz(e|ed|es|ing|ation|ations|er|ers)?"
    "|authenticat(e|ed|es|ing|ion|ions|or|ors)?|cookie|cookies|migrat(e|ed|es|ing|ion|ions)"
    "|schema|schemas|secret|secrets|credential|credentials|payment|payments|billing|security"
    "|password|passwords|token|tokens|permission|permissions|encrypt(s|ed|ing|ion|ions)?"
    "|decrypt(s|ed|ing|ion|ions)?"
)
WEAK_PATH_WORDS = "session|sessions"


def parse_change_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``provider, host, path, number``; all null when the link is not canonical."""
    u = F.col(url)
    owner, repo = F.regexp_extract(u, PULL_URL, 1), F.regexp_extract(u, PULL_URL, 2)
    pull = u.rlike(PULL_URL) & ~owner.contains("--") & ~repo.isin(".", "..")
    host, path = F.regexp_extract(u, MERGE_URL, 1), F.regexp_extract(u, MERGE_URL, 2)
    segments = F.split(path, "/")
    bad_segment = F.exists(segments, lambda s: (
        (F.length(s) < 1) | (F.length(s) > 255) | s.isin(".", "..") | s.startswith("-")
        | s.endswith(".git") | s.endswith(".atom")))
    bad_label = F.exists(F.split(host, r"\."), lambda s: (
        (F.length(s) < 1) | (F.length(s) > 63) | s.startswith("-") | s.endswith("-")))
    merge = (
        u.rlike(MERGE_URL) & (host != "github.com") & ~bad_label & ~bad_segment
        & F.length(path).between(3, 1024) & F.size(segments).between(2, 20)
    )
    return (
        df.withColumn("provider", F.when(pull, "github").when(merge, "gitlab"))
        .withColumn("host", F.when(pull, "github.com").when(merge, host))
        .withColumn("path", F.when(pull, F.concat(owner, F.lit("/"), repo)).when(merge, path))
        .withColumn("number", F.when(pull, F.regexp_extract(u, PULL_URL, 3))
                    .when(merge, F.regexp_extract(u, MERGE_URL, 3)))
    )


def audit_change_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Links, distinct repositories and the highest number per provider; rejects under their own."""
    parsed = parse_change_url(df, url)
    repo = F.concat_ws("/", "host", "path")
    per_repo = parsed.groupBy(F.coalesce("provider", F.lit("rejected")).alias("provider"),
                              F.when(F.col("provider").isNotNull(), repo).alias("repo")).agg(
        F.count("*").alias("n"), F.max(F.length("number")).alias("digits"))
    return per_repo.groupBy("provider").agg(
        F.sum("n").alias("links"), F.count("repo").alias("repos"),
        F.coalesce(F.max("digits"), F.lit(0)).cast("long").alias("number_digits"))


def audit_traces(df: DataFrame) -> DataFrame:
    """Per source: rows, rows whose trace is not valid, distinct traces and the widest trace.
    ``df``: ``source, task, traceparent``. Counted per (source, trace) first, so that a hot trace
    or source combines before the shuffle."""
    tp = F.col("traceparent")
    valid = F.coalesce(
        tp.rlike(TRACE) & (F.substring(tp, 4, 32) != "0" * 32) & (F.substring(tp, 37, 16) != "0" * 16),
        F.lit(False),
    )
    per_task = df.groupBy(
        "source", F.when(valid, F.substring(tp, 4, 32)).alias("trace"), "task"
    ).agg(F.count("*").alias("n"))
    per_trace = per_task.groupBy("source", "trace").agg(
        F.sum("n").alias("n"), F.count("*").alias("tasks"))
    is_trace = F.col("trace").isNotNull()
    return per_trace.groupBy("source").agg(
        F.sum("n").alias("spans"),
        F.coalesce(F.sum(F.when(~is_trace, F.col("n"))), F.lit(0)).alias("invalid"),
        F.count("trace").alias("traces"),
        F.coalesce(F.max(F.when(is_trace, F.col("tasks"))), F.lit(0)).alias("widest"),
    )


def provenance_counts(
    df: DataFrame, label: str, kinds: Sequence[str] = MESSAGE_KINDS, text: str = "text"
) -> DataFrame:
    """Messages per conversation and structural kind."""
    kind = tx.message_kind(F.col(text), kinds, label)
    return df.groupBy("conv_id", kind.alias("kind")).agg(F.count("*").alias("messages"))


def path_is_risky(path: Column) -> Column:
    """Does a lower-cased changed path touch a risky surface?"""
    strong, weak = f"^({STRONG_PATH_WORDS})$", f"^({WEAK_PATH_WORDS})$"

    def risky(part: Column) -> Column:
        stem = F.regexp_replace(part, r"\.[^.]*$", "")
        whole = part.rlike(f"{strong}|{weak}") | stem.rlike(f"{strong}|{weak}")
        return whole | F.exists(F.split(stem, "[._-]"), lambda t: t.rlike(strong))

    always = path.rlike(r"(^|/)\.github/workflows/|dockerfile|docker-compose")
    return always | F.exists(F.split(path, "/"), risky)


def risky_paths(df: DataFrame) -> DataFrame:
    """Changed paths that touch a risky surface. ``df``: ``doc_id, path``."""
    return df.filter(path_is_risky(F.lower("path")))


def tier_breaches(
    df: DataFrame, *, trivial_files: int = 2, trivial_lines: int = 30, trivial_age: int = 1800,
    heavy_files: int = 8, heavy_lines: int = 400,
) -> DataFrame:
    """One row per ceiling a task has outgrown. ``df``: ``task, trivial, files, lines, age_secs``."""
    files, lines = F.col("files"), F.col("lines")
    breaches = F.array_compact(F.array(
        F.when(F.col("trivial") & ((files > trivial_files) | (lines > trivial_lines)), "trivial-size"),
        F.when(F.col("trivial") & (F.col("age_secs") > trivial_age), "trivial-age"),
        F.when((files > heavy_files) | (lines > heavy_lines), "heavy-size"),
    ))
    return df.select(*df.columns, F.explode(breaches).alias("breach"))


def classify_tests(df: DataFrame, families: DataFrame, outputs: str = "output") -> DataFrame:
    """Family by name (``unclassified`` without one) and whether the first non-empty output line
    announces a skip. ``df``: ``name, output``."""
    first = F.regexp_extract(F.col(outputs), r"^(?:[ \t]*\r?\n)*([^\n]*)", 1)
    return df.join(families.select("name", "family"), "name", "left").select(
        *df.columns,
        F.coalesce("family", F.lit("unclassified")).alias("family"),
        first.startswith("skip:").alias("gate_skip"),
    )


def overlapping_paths(df: DataFrame) -> DataFrame:
    """Conflicting ownership: one path owned twice, one id owning twice, a path inside another.

    ``df``: ``path, id``. Containment is an equi-join of each path's proper ancestors with the
    paths, so the cost grows with depth and not with the square of the rows. Duplicates are
    reported once per path or id with the number of owners, never as pairs."""
    owned = df.select("path", "id").distinct()
    by_path = owned.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    by_id = owned.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    parts = F.split("path", "/")
    depth = F.size(parts)
    above = F.transform(
        F.sequence(F.lit(1), depth - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inner = by_path.withColumn("above", F.explode(F.when(depth > 1, above))).filter("above <> ''")
    outer = by_path.select(F.col("path").alias("above"), F.col("id").alias("outer_id"))
    contained = inner.join(outer, "above").select(
        F.lit("contained").alias("kind"), F.col("above").alias("path"), F.col("outer_id").alias("id"),
        F.col("path").alias("other"), F.lit(2).cast("long").alias("n"))
    none = F.lit(None).cast("string").alias("other")
    return contained.unionByName(
        by_path.filter("n > 1").select(F.lit("duplicate-path").alias("kind"), "path", "id", none, "n")
    ).unionByName(
        by_id.filter("n > 1").select(F.lit("duplicate-id").alias("kind"), "path", "id", none, "n"))


def impacted_families(paths: DataFrame, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Families to run for each changed path. ``rules`` is an ordered list of a pattern and its
    families; the first pattern that fits wins and may select several. A path without a rule gives
    the row ``unmapped``. The rules are a short fixed list, so they become one expression."""
    chosen = F.array(F.lit("unmapped"))
    for pattern, families in reversed(rules):
        named = F.array(*[F.lit(f) for f in families]) if families else F.array().cast("array<string>")
        chosen = F.when(F.col("path").rlike(pattern), named).otherwise(chosen)
    return paths.select(*paths.columns, F.explode(chosen).alias("family"))


def tests_referencing(names: DataFrame, tests: DataFrame) -> DataFrame:
    """Tests whose text holds a name anywhere, letter by letter: ``name, test``.

    ``names``: ``name``; ``tests``: ``test, text``. Of the strings of three characters in a name (a shorter name: all of
    it) the one that the fewest texts hold is its key; names and texts meet in an equi-join on it, and containment then
    decides. Names of one prefix thus meet by what tells them apart. Only strings that some name has are counted."""
    def grams(text: str, sizes: tuple[int, ...]) -> Column:
        return F.concat(*[F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)) for k in sizes])

    wanted = names.select("name").distinct().filter(F.length("name") > 0)
    keys = wanted.select("name", F.explode(F.when(F.length("name") < 3, F.array("name")).otherwise(grams("name", (3,)))).alias("gram"))
    held = tests.select("test", F.explode(grams("text", (1, 2, 3))).alias("gram"))
    # Written first, the strings of the names have a known size: few, and they meet the texts where these are read; the
    # strings of the texts move only where those of the names are too many for that.
    held = lineage.cut(held.join(lineage.written(keys.select("gram").distinct()), "gram", "left_semi"))
    texts = held.groupBy("gram").agg(F.count("*").alias("texts"))
    # A string that no text holds rules its name out.
    rarest = keys.join(texts, "gram", "left").groupBy("name").agg(
        F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.min(F.coalesce("texts", F.lit(0))).alias("least"))
    pairs = held.join(rarest.filter("least > 0").select("name", "gram"), "gram").select("name", "test")
    return pairs.join(tests, "test").filter(F.col("text").contains(F.col("name"))).select("name", "test")


# --- links -----------------------------------------------------------------------------------

# The shapes of links, headings and anchors.
MARKDOWN_LINK = r"!?\[[^\]]*\]\(([^)]+)\)"
HTML_LINK = r"""(?i)\b(?:href|src)=["']([^"']+)["']"""
HEADING = r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$"
EXPLICIT_ANCHOR = r"""(?i)<(?:a|span)\s+(?:name|id)=["']([^"']+)["']"""


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of a page: ``path, raw, target, fragment, status``. ``pages``: ``path, text``.

    ``target`` is the local path resolved against the page; ``status`` is ``external``,
    ``absolute``, ``escapes`` (climbs above the root) or ``local``."""
    found = F.concat(
        F.regexp_extract_all("text", F.lit(MARKDOWN_LINK), 1),
        F.regexp_extract_all("text", F.lit(HTML_LINK), 1),
    )
    rows = pages.select("path", F.explode(found).alias("raw"))
    value = F.trim(F.regexp_replace(F.trim("raw"), r"^<(.*)>$", "$1"))
    value = F.element_at(F.split(value, r"\s+"), 1)
    rows = rows.withColumn("__v", value)
    before_fragment = F.substring_index("__v", "#", 1)
    anchor = F.regexp_replace("__v", "^[^#]*#", "")
    # A fragment with a stray percent sign stands for itself.
    clear = F.coalesce(F.try_url_decode(F.regexp_replace(anchor, r"\+", "%2B")), anchor)
    rows = rows.withColumn("__p", F.substring_index(before_fragment, "?", 1)).withColumn(
        "fragment", F.when(F.col("__v").contains("#"), clear))
    folder = F.regexp_replace("path", "[^/]*$", "")
    decoded = F.try_url_decode(F.regexp_replace("__p", r"\+", "%2B"))
    joined = F.concat(folder, F.coalesce(decoded, F.col("__p")))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        skip = part.isin("", ".")
        here = acc["at"]
        return F.struct(
            F.when(skip | (up & (F.size(here) == 0)), here)
            .when(up, F.slice(here, F.lit(1), F.size(here) - 1))
            .otherwise(F.array_append(here, part)).alias("at"),
            (acc["out"] | (up & (F.size(here) == 0))).alias("out"),
        )

    walk = F.aggregate(F.split(joined, "/"), start, step)
    rows = rows.withColumn("__w", walk)
    external = F.col("__v").rlike("^([A-Za-z][A-Za-z0-9+.-]*:|//)")
    status = (
        F.when(external, "external")
        .when((F.col("__p") == "") & F.col("fragment").isNull(), "empty")
        .when(F.col("__p").startswith("/"), "absolute")
        .when((F.col("__p") != "") & F.col("__w.out"), "escapes")
        .otherwise("local")
    )
    target = F.when(F.col("__p") == "", F.col("path")).otherwise(F.array_join("__w.at", "/"))
    return rows.withColumn("status", status).select(
        "path", "raw", F.when(F.col("status") == "local", target).alias("target"), "fragment", "status")


def page_anchors(pages: DataFrame) -> DataFrame:
    """Distinct anchors: heading slugs, the n-th repeat with ``-n``, and explicit names.

    Repeats are numbered within one document, whose size bounds the group."""
    headings = pages.select("path", F.posexplode(
        F.regexp_extract_all("text", F.lit(HEADING), 1)).alias("pos", "title"))
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace("title", "<[^>]+>", ""), "`", "")))
    slug = F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\- ]", ""), r"\s", "-")
    slugs = headings.select("path", "pos", slug.alias("slug")).filter("slug <> ''")
    place = slugs.groupBy("path", "slug").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    numbered = place.select("path", "slug", F.posexplode("at").alias("n", "pos"))
    auto = numbered.select("path", F.when(F.col("n") == 0, F.col("slug")).otherwise(
        F.concat_ws("-", "slug", F.col("n").cast("string"))).alias("anchor"))
    named = pages.select("path", F.explode(
        F.regexp_extract_all("text", F.lit(EXPLICIT_ANCHOR), 1)).alias("anchor"))
    return auto.unionByName(named).distinct()


def audit_links(pages: DataFrame, inventory: DataFrame) -> DataFrame:
    """Problems of a set of pages: ``kind, path, subject``.

    ``pages``: ``path, text``; ``inventory``: ``path, audience`` rows that classify the pages.
    Kinds: ``unclassified``, ``extra``, ``duplicate``, ``absolute``, ``escapes``,
    ``unresolved-link``, ``unresolved-anchor``."""
    paths = pages.select("path").distinct()
    listed = inventory.groupBy("path").agg(F.count("*").alias("n"))

    def rows(df: DataFrame, kind: str, subject: str = "path") -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col("path"), F.col(subject).alias("subject"))

    out = rows(paths.join(listed, "path", "left_anti"), "unclassified")
    out = out.unionByName(rows(listed.join(paths, "path", "left_anti"), "extra"))
    out = out.unionByName(rows(listed.filter("n > 1"), "duplicate"))
    links = page_links(pages)
    for status in ("absolute", "escapes"):
        out = out.unionByName(rows(links.filter(F.col("status") == status), status, "raw"))
    local = links.filter(F.col("status") == "local")
    known = paths.select(F.col("path").alias("target"))
    out = out.unionByName(rows(local.join(known, "target", "left_anti"), "unresolved-link", "raw"))
    anchors = page_anchors(pages).select(F.col("path").alias("target"), F.col("anchor").alias("fragment"))
    pointed = local.filter(F.col("fragment").isNotNull() & (F.col("fragment") != "")).join(
        known, "target", "left_semi")
    return out.unionByName(rows(
        pointed.join(anchors, ["target", "fragment"], "left_anti"), "unresolved-anchor", "raw"))
