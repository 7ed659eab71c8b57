"""Line dedup by an exact set-similarity join: a line goes if an earlier one is equal or similar enough.

A line is the set of its five-word shingles (a shorter line: of its whole word sequence). Earlier means a smaller
document id, or a smaller place in the same document. Lines without words stay.

Equal lines are found by hash aggregates, and only the first of them takes part in what follows. For the others:

1. Prefix filter: lines of ``n`` tokens with similarity ``t`` share one of their ``n - ceil(t * n) + 1`` first ones, in
   any order that holds for all lines. The order is that of the hashes, so one pass over the texts is enough. Only
   prefixes are dealt, and only where two lines of similar sizes have a token in them.
2. Length and positional filters: sizes within the similarity of each other, and enough tokens left behind the shared
   one to reach the needed overlap.
3. Verification by the Jaccard similarity of the token sets.
4. Crowded tokens, which more than ``CROWD`` lines have in their prefixes: lines with one are compared anew, in an
   order by rarity. Their tokens are counted in ``BUCKETS`` hash buckets (a table of fixed size), and a token's place is
   the logarithmic level of its bucket, then its hash, so what many lines share comes last. If the first token that a
   similar pair shares is not crowded, step 2 keeps the pair; if it is, both lines come here.

A token's lines are first compared with two of them alone, the earliest and the one in which the token comes first, which
settles families of near copies without their pairs; only lines that this leaves open meet the other earlier ones.

Disk: the matches are a table before the texts are cut, and every step deletes its shuffle files when it ends, so that the
texts are in one shuffle at a time. Texts are joined by sorting: lists of lines take little room in a file and would be
broadcast by that size.

All of it is DataFrame functions. Tokens are 64-bit hashes of the words.

Nulls and odd cases: null text has no lines and stays null; null ids come last; rows that share an id, or have none, are
documents of their own, in the order in which they are read; an empty table gives an empty result; other columns are kept,
but for ``n_lines`` and ``n_removed`` where these are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.base import global_rank, query, shuffles_released, stage, table

SHINGLE = 5
#: Similarity as a fraction of whole numbers, so that bounds are exact.
SIMILAR = (4, 5)
BUCKETS = 1 << 16
#: Most lines with a token in their prefixes that are compared by the order of the hashes.
CROWD = 64
_BLANK_CHARS = " \t\n\x0b\f\r"
_LAST = (1 << 63) - 1


def _order_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def with_place(docs: DataFrame) -> DataFrame:
    """Add ``__did``, a number of its own for every document, that orders them. It is the id, unless rows share one: then
    the rows are written once with their number as read, and placed by id and number."""
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if shared.isEmpty():
        return docs.withColumn("__did", _order_id(F.col("doc_id")))
    rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()))
    placed = global_rank(rows.select("doc_id", "__row"), [F.col("doc_id").asc_nulls_last(), F.col("__row")], "__did")
    placed = placed.select(F.col("__row").alias("__r"), "__did")
    return stage(rows.join(placed, F.col("__row") == F.col("__r")).drop("__row", "__r"))


def _has_words(line: str) -> Column:
    return F.length(F.btrim(line, F.lit(_BLANK_CHARS))) > 0


def lines_of(docs: DataFrame) -> DataFrame:
    """``did, no, line`` of every line with words; ``did`` is the document's place."""
    split = docs.select(F.col("__did").alias("did"), F.posexplode_outer(F.split("text", "\n")).alias("no", "line"))
    return split.filter(_has_words("line"))


def lines_without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``lines_of`` without the lines of ``gone`` (``did, no``), which meet their documents before these are split."""
    own = gone.groupBy(F.col("did").alias("of")).agg(F.collect_list("no").alias("nos"))
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("__did").alias("did"), "text")
    # Each array that a lambda reads is a column of its own first.
    split = texts.join(own.hint("merge"), F.col("did") == F.col("of"), "left").withColumn("lines", F.split("text", "\n"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    left = split.withColumn("left", F.array_except(every, F.coalesce("nos", F.array().cast("array<int>"))))
    line = F.transform("left", lambda i: F.struct(i.alias("no"), F.get("lines", i).alias("line")))
    return left.select("did", F.explode(line).alias("x")).select("did", "x.no", "x.line").filter(_has_words("line"))


def with_shingles(lines: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Add ``shingles``, repeats included: structs of word hashes, to be hashed into tokens by ``token_of``. The array
    that others are cut from is a column of its own first, or it would be computed for each of them."""
    other = _BLANK_CHARS.replace(" ", "")
    # Splitting at one character needs no regular expression, so the rare other blanks become spaces before.
    odd = reduce(lambda x, y: x | y, (F.contains("line", F.lit(c)) for c in other))
    plain = F.when(odd, F.translate("line", other, " " * len(other))).otherwise(F.col("line"))
    hashes = F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))
    words = lines.withColumn("words", F.array_remove(hashes, F.xxhash64(F.lit(""))))
    shifted = [F.slice("words", k + 1, F.greatest(F.lit(0), F.size("words") - k)) for k in range(1, shingle)]
    # The last places have shorter sequences; a line shorter than a shingle has one, at its start.
    full = F.greatest(F.lit(1), F.size("words") - (shingle - 1))
    return words.withColumn("shingles", F.slice(F.arrays_zip("words", *shifted), F.lit(1), full)).drop("words")


def token_of(shingle: Column) -> Column:
    return F.xxhash64(shingle)


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity_levels(sets: DataFrame) -> DataFrame:
    """One row with the rarity level of every bucket, in the top bits of a long: a table of fixed size. ``sets`` are as
    ``_similar`` reads them."""
    tokens = sets.select(F.explode(F.slice("body", F.lit(2), F.size("body") - 1)).alias("t"))
    counts = tokens.groupBy(_bucket(F.col("t")).alias("b")).count()
    every = sets.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    level = F.least(F.lit(127), F.floor(4 * F.log2(1 + F.coalesce("count", F.lit(0))))).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("b", F.shiftleft(level, 55).alias("level"))))
    return every.join(counts, "b", "left").agg(F.transform(rows, lambda x: x["level"]).alias("levels"))


def _needed(n: Column) -> Column:
    """Least size of a set similar to one of ``n``: ceil(t * n)."""
    top, bottom = SIMILAR
    return F.expr(f"({top} * n + {bottom - 1}) div {bottom}")


def _first_codes(coded: DataFrame) -> DataFrame:
    """``did, no, n, pos, code`` of the first of the sorted ``codes`` of every line, with their place."""
    sized = coded.withColumn("n", F.size("codes"))
    own = F.slice("codes", 1, F.col("n") - _needed(F.col("n")) + 1)
    return sized.select("did", "no", "n", F.posexplode(own).alias("pos", "code"))


def prefixes(lines: DataFrame) -> DataFrame:
    """The prefix of every line by the order of the hashes."""
    tokens = F.array_distinct(F.transform("shingles", token_of))
    return _first_codes(with_shingles(lines).select("did", "no", F.sort_array(tokens).alias("codes")))


def rare_prefixes(sets: DataFrame, levels: DataFrame) -> DataFrame:
    """The prefix of every line by rarity."""
    marked = sets.withColumn("levels", levels.scalar())

    def code(t: Column) -> Column:
        return F.get("levels", _bucket(t)).bitwiseOR(F.shiftrightunsigned(t, 9))

    tokens = F.slice("body", F.lit(2), F.size("body") - 1)
    return _first_codes(marked.select("did", "no", F.sort_array(F.transform(tokens, code)).alias("codes")))


def exact_repeats(lines: DataFrame) -> DataFrame:
    """Lines equal to an earlier one (``did, no, h``)."""
    hashed = stage(lines.select("did", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    groups = hashed.groupBy("h1", "h2").agg(F.min(F.struct("did", "no")).alias("first"), F.count("*").alias("copies"))
    groups = stage(groups.filter("copies > 1").select(
        F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first.did").alias("did0"), F.col("first.no").alias("no0")
    ))
    later = hashed.join(groups, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter(
        (F.col("did") != F.col("did0")) | (F.col("no") != F.col("no0"))
    )
    return stage(later.select("did", "no", F.col("h1").alias("h")))


def _with_partner(postings: DataFrame) -> DataFrame:
    """Rows whose token is in the prefix of another line of similar size: the next in size is one if any is."""
    top, bottom = SIMILAR
    by_size = Window.partitionBy("code").orderBy("n")
    sided = postings.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    return sided.filter((F.col("less") * bottom >= F.col("n") * top) | (F.col("n") * bottom >= F.col("more") * top)).drop("less", "more")


def candidates(postings: DataFrame) -> DataFrame:
    """Rows of ``postings`` with a partner, with the number of ``lines`` of their token, and with two of these to try
    before others: the ``first`` one, and the ``plain`` one, in which the token comes first. By rarity that is, among
    variants of one line, the unchanged line, as every change puts rarer tokens before the shared ones."""
    whole = Window.partitionBy("code")
    line = F.struct("did", "no", "n", "pos")
    marked = _with_partner(postings).withColumns({
        "lines": F.count("*").over(whole), "first": F.min(line).over(whole), "last": F.max(line).over(whole),
        "plain": F.min(F.struct("pos", "did", "no", "n")).over(whole),
    })
    # Where there are only two lines, they are all that the token can bring together.
    fits = _may_match(F.col("first.n"), F.col("first.pos"), F.col("last.n"), F.col("last.pos"))
    return stage(marked.filter((F.col("lines") > 2) | fits).drop("last"))


def _may_match(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Length and positional filters. Similar sets overlap by at least t / (1 + t) of their sizes' sum. All that a pair
    shares lies at or behind its first shared token in both, so at that token (which both prefixes hold) a similar pair
    always passes."""
    top, bottom = SIMILAR
    longest = F.least(n_a - pos_a, n_b - pos_b)
    return (
        (F.least(n_a, n_b) * bottom >= F.greatest(n_a, n_b) * top)
        & (longest * (top + bottom) >= (n_a + n_b) * top)
    )


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (``a_did, a_no, b_did, b_no``) whose token sets are similar; gives the later lines, once for
    each pair, so that a line with many pairs can be split among tasks. Both sides read the same columns of ``sets`` (a
    line's hash, then its tokens, in one array), so they share one exchange."""
    top, bottom = SIMILAR
    a = sets.select(F.col("did").alias("a_d"), F.col("no").alias("a_o"), F.col("body").alias("a_body"))
    b = sets.select(F.col("did").alias("b_d"), F.col("no").alias("b_o"), F.col("body").alias("b_body"))
    met = pairs.join(a, (F.col("a_did") == F.col("a_d")) & (F.col("a_no") == F.col("a_o"))).drop("a_d", "a_o")
    met = met.join(b, (F.col("b_did") == F.col("b_d")) & (F.col("b_no") == F.col("b_o"))).drop("b_d", "b_o")
    n_a, n_b = F.size("a_body") - 1, F.size("b_body") - 1
    shared = F.size(F.array_intersect(F.slice("a_body", F.lit(2), n_a), F.slice("b_body", F.lit(2), n_b)))
    alike = shared * (top + bottom) >= (n_a + n_b) * top
    return met.filter(alike).select(F.col("b_did").alias("did"), F.col("b_no").alias("no"), F.col("b_body")[0].alias("h"))


def _is_line(name: str) -> Column:
    return (F.col("did") == F.col(f"{name}.did")) & (F.col("no") == F.col(f"{name}.no"))


def _without(rows: DataFrame, done: DataFrame) -> DataFrame:
    gone = done.select(F.col("did").alias("d"), F.col("no").alias("o"))
    return rows.join(gone, (F.col("did") == F.col("d")) & (F.col("no") == F.col("o")), "left_anti")


def _leader_pairs(posted: DataFrame) -> DataFrame:
    """Every line with the two lines of each of its tokens that are tried first, where these are earlier."""

    def with_line(name: str) -> DataFrame:
        before = (F.col(f"{name}.did") < F.col("did")) | ((F.col(f"{name}.did") == F.col("did")) & (F.col(f"{name}.no") < F.col("no")))
        fits = _may_match(F.col(f"{name}.n"), F.col(f"{name}.pos"), F.col("n"), F.col("pos"))
        return posted.filter(before & fits).select(
            F.col(f"{name}.did").alias("a_did"), F.col(f"{name}.no").alias("a_no"), F.col("did").alias("b_did"), F.col("no").alias("b_no"))

    return with_line("first").unionByName(with_line("plain")).distinct()


def _other_pairs(rest: DataFrame, posted: DataFrame) -> DataFrame:
    """The lines of ``rest`` with all other earlier lines of their tokens."""
    a = posted.filter(~_is_line("first") & ~_is_line("plain")).select(
        F.col("code").alias("c"), F.col("did").alias("a_did"), F.col("no").alias("a_no"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos")
    )
    earlier = (F.col("a_did") < F.col("did")) | ((F.col("a_did") == F.col("did")) & (F.col("a_no") < F.col("no")))
    pairs = rest.join(a, (F.col("code") == F.col("c")) & earlier & _may_match(F.col("a_n"), F.col("a_pos"), F.col("n"), F.col("pos")))
    return pairs.select("a_did", "a_no", F.col("did").alias("b_did"), F.col("no").alias("b_no")).distinct()


def _crowded_matches(own: DataFrame, done: DataFrame) -> DataFrame:
    """Matches among the lines of ``own``, of those that are not ``done``, by the order of rarity."""
    posted = candidates(rare_prefixes(own, stage(rarity_levels(own))))
    settled = stage(_similar(_leader_pairs(_without(posted, done)), own))
    rest = _without(_without(posted, done), settled)
    return settled.unionByName(stage(_similar(_other_pairs(rest, posted), own)))


def later_matches(docs: DataFrame) -> DataFrame:
    """``did, no, h``: every line that equals or resembles an earlier one, with the hash of the line. ``docs`` are placed."""
    repeats = exact_repeats(lines_of(docs))
    posted = candidates(prefixes(lines_without(docs, repeats)))
    # The token sets of all lines that are left, from one more pass over the texts.
    wanted = posted.groupBy("did", "no").agg(F.max("lines").alias("most"))
    wanted = wanted.groupBy(F.col("did").alias("w")).agg(F.collect_list(F.struct("no", "most")).alias("nos"))
    texts = docs.select(F.col("__did").alias("did"), "text")
    picked = texts.join(wanted.hint("merge"), F.col("did") == F.col("w")).withColumn("lines", F.split("text", "\n"))
    line = F.transform("nos", lambda i: F.struct(i["no"].alias("no"), i["most"].alias("most"), F.get("lines", i["no"]).alias("line")))
    picked = picked.select("did", F.explode(line).alias("x")).select("did", "x.no", "x.most", "x.line").filter(F.col("line").isNotNull())
    body = F.concat(F.array(F.xxhash64("line")), F.array_distinct(F.transform("shingles", token_of)))
    sets = stage(with_shingles(picked).select("did", "no", "most", body.alias("body")))

    settled = stage(_similar(_leader_pairs(posted), sets))
    # Of a token's two lines, one is the first; a crowded token's first line has no earlier one there.
    others = posted.filter(f"lines > 2 AND lines <= {CROWD}")
    pairs = _other_pairs(_without(others, settled), others)
    found = repeats.unionByName(settled).unionByName(stage(_similar(pairs, sets.filter("most > 2"))))
    still = _without(posted.filter((F.col("lines") > CROWD) & ~_is_line("first")), settled)
    return found if still.isEmpty() else found.unionByName(_crowded_matches(sets.filter(F.col("most") > CROWD), settled))


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """The documents without their later matches; with ``counts`` adds ``n_lines`` and ``n_removed``."""
    with shuffles_released(docs.sparkSession):
        placed = with_place(docs)
        found = later_matches(placed).select("did", "no").distinct()
        gone = stage(found.groupBy(F.col("did").alias("__of")).agg(F.collect_list("no").alias("__gone")))
    met = placed.join(gone.hint("merge"), F.col("__did") == F.col("__of"), "left")
    # Each array that a lambda reads is a column of its own first, as above.
    met = met.withColumn("__lines", F.split("text", "\n"))
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    met = met.withColumn("__kept", F.array_except(every, F.coalesce("__gone", F.array().cast("array<int>"))))
    text = F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")
    n = F.coalesce(F.when(F.col("text").isNotNull(), F.size("__lines")), F.lit(0)).cast("long")
    left = F.coalesce(F.when(F.col("text").isNotNull(), F.size("__kept")), F.lit(0)).cast("long")
    new = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(text)
    # In two steps: in one, a lambda's "text" would mean the new column.
    met = met.withColumns({"__text": new, "__n": n, "__left": left})
    added = [F.col("__n").alias("n_lines"), (F.col("__n") - F.col("__left")).alias("n_removed")] if counts else []
    kept = [c for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    return met.select(*[F.col("__text").alias("text") if c == "text" else F.col(c) for c in kept], *added)


SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS no, unnest(parts) AS line FROM split),
worded AS (
  SELECT doc_id, no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM lines),
sets AS (
  SELECT doc_id, no, list_distinct(list_transform(range(1, greatest(1, len(words) - 4) + 1), lambda i: words[i:i + 4])) AS tokens
  FROM worded WHERE len(words) > 0),
classes AS (
  SELECT list_sort(tokens) AS tokens, min((doc_id, no)) AS first FROM sets GROUP BY ALL),
exploded AS (
  SELECT first, len(tokens) AS n, unnest(tokens) AS token FROM classes),
alike AS (
  SELECT a.first AS a, b.first AS b, any_value(a.n) AS a_n, any_value(b.n) AS b_n, count(*) AS shared
  FROM exploded a JOIN exploded b ON a.token = b.token AND a.first < b.first GROUP BY a.first, b.first),
later AS (
  SELECT DISTINCT b AS first FROM alike WHERE 9 * shared >= 4 * (a_n + b_n)),
gone AS (
  SELECT s.doc_id, s.no FROM sets s JOIN classes c ON list_sort(s.tokens) = c.tokens
  WHERE (s.doc_id, s.no) <> c.first OR c.first IN (SELECT first FROM later))
SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (g.no IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id
"""


@query("op10_line_dedup", SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "text"
    )
