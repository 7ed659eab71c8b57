"""Corpus jobs over a table of documents: scope narrowing, risk terms, chunking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.functions import briefs

# The risk vocabulary. Ambiguous heads count only near a qualifier or another head.
RISK_WORDS = (
    "auth|authn|authz|authentication"
    "|(un|re|de|pre)authoriz(e|ed|es|ing|ation|ations|er|ers)?"
    "|(un|re|de|pre)?authenticat(e|ed|es|ing|ion|ions|or|ors)?"
    "|cookie|login|credential|password|secret|payment|billing|migrat(e|ed|es|ing|ion|ions)"
    "|schema|security|encrypt|decrypt|permission|injection"
)
RISK_SUFFIX = "(s|es|ed|ing|ion|ions)?"
RISK_PHRASES = "access control|data deletion|bulk mutation|public exposure|breaking change"
PAIR_HEADS = (
    "sessions?|tokens?|uids?|identity|identities"
    "|authoriz(e|ed|es|ing|ation|ations|er|ers)?"
)
PAIR_QUALIFIERS = (
    "auth|authn|authz|authenticat(e|ed|es|ing|ion|ions|or|ors)?|unauthenticated|unauthorized"
    "|login|logins|logged|signin|sso|oauth|jwt|saml|csrf|xsrf|bearer|refresh|access|api|invite"
    "|reset|pairing|rotat(e|ed|es|ing|ion)|revoke|revoked|revocation|expiry|expiration|cookie"
    "|cookies|credential|credentials|secret|secrets|password|passwords|key|keys|id|ids"
    "|identifier|identifiers|user|users|gate|gated|gating|guard|guards|check|checks|header"
    "|headers|middleware|endpoint|endpoints|route|routes|request|requests|role|roles|permission"
    "|permissions|privilege|privileges|policy|policies|bypass|enforce|enforced|enforcement|admin"
    "|hijack|hijacked|hijacking|fixation|spoof|spoofed|spoofing|store|provider|platform|expire"
    "|expires|expired|expiring|logout|logouts|invalidate|invalidated|invalidation"
)
PAIR_REACH = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def tokens(col: Column) -> Column:
    """ASCII words of a lower-cased text."""
    return F.regexp_extract_all(ascii_lower(col), F.lit("([a-z0-9]+)"), 1)


def spread(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Use all cores when the source offers fewer splits than there are cores (a table of one small
    file); a table of many splits is left as it is, without a shuffle of its texts."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    if documents.rdd.getNumPartitions() >= cores:
        return documents
    return documents.repartition(cores, key)


#: Bytes of text, and rows, that a task gives on at a time.
_BYTES, _ROWS = 1 << 20, 4096


def _bounded(rows: Iterator[tuple], size: Callable[[tuple], int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches that end at ``_BYTES`` or ``_ROWS``."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= _BYTES or len(held) >= _ROWS:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``doc_id, text`` of one row at a time: a batch of long texts stays in Arrow's memory, once."""
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            yield doc.as_py(), text.as_py()


def narrow_scope(documents: DataFrame) -> DataFrame:
    """``doc_id, clauses``: the clauses of each document that describe the work. The state a parser
    carries through a document makes this a Python job; documents are independent, and a task holds the clauses
    of a bounded number of them."""
    kind = documents.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("clauses", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((doc, briefs.narrow(text) if text is not None else []) for doc, text in _texts(batches))
        yield from _bounded(found, lambda row: sum(map(len, row[1])), schema)

    texts = spread(documents.select("doc_id", "text"))
    return texts.mapInArrow(run, f"doc_id {kind.simpleString()}, clauses array<string>")


def scope_clauses(documents: DataFrame) -> DataFrame:
    """One row per surviving clause: ``doc_id, clause_no, text``."""
    return narrow_scope(documents).select(
        "doc_id", F.posexplode("clauses").alias("clause_no", "text"))


def pairs_in(words: Column) -> Column:
    """Qualified ambiguous pairs of one clause, in reading order of the heads: the nearest
    neighbour within reach decides, left before right. Works on the clause's word array, so no
    row moves between tasks."""
    head = f"^({PAIR_HEADS})$"
    near = f"^({PAIR_QUALIFIERS}|{PAIR_HEADS})$"

    def word(i: Column) -> Column:
        return F.get(words, i)

    def pair_at(w: Column, i: Column) -> Column:
        options = []
        for d in range(1, PAIR_REACH + 1):
            left, right = word(i - d), word(i + d)
            options.append(F.when(left.rlike(near), F.concat_ws(" ", left, w)))
            options.append(F.when(right.rlike(near), F.concat_ws(" ", w, right)))
        return F.when(w.rlike(head), F.coalesce(*options))

    return F.array_compact(F.transform(words, pair_at))


def pairs_of(text: Column) -> Column:
    """Pairs of a clause given as text; the one-element array binds the words once."""
    return F.get(F.transform(F.array(tokens(text)), pairs_in), F.lit(0))


def pair_hits(clauses: DataFrame) -> DataFrame:
    """Pairs per clause. ``clauses``: ``doc_id, clause_no, text``."""
    return clauses.select(
        "doc_id", "clause_no", F.explode(pairs_of(F.col("text"))).alias("pair"))


def risk_terms(scoped: DataFrame) -> DataFrame:
    """``doc_id, hits``: sorted distinct risk words, phrases and pairs of the narrowed clauses.
    Words and phrases are matched over the whole text, pairs inside one clause."""
    flat = tokens(F.array_join("clauses", "\n"))
    whole = f"^({RISK_WORDS}){RISK_SUFFIX}$"
    words = F.filter("words", lambda w: w.rlike(whole))
    phrases = F.regexp_extract_all(
        F.array_join("words", " "), F.lit(f"((?:{RISK_PHRASES}){RISK_SUFFIX})"), 1)
    pairs = F.flatten(F.transform(F.transform("clauses", tokens), pairs_in))
    # A document without any risk stem skips the pair walk.
    maybe = F.exists("words", lambda w: w.rlike(f"^({PAIR_HEADS})$"))
    found = F.concat(words, phrases, F.when(maybe, pairs).otherwise(F.array().cast("array<string>")))
    return scoped.withColumn("words", flat).select(
        "doc_id", F.array_sort(F.array_distinct(found)).alias("hits"))


def chunk_texts(documents: DataFrame, limit: int, cap: int) -> DataFrame:
    """``doc_id, k, n, lost, chunk``: numbered chunks of at most ``limit`` characters; ``lost`` counts
    the chunks that ``cap`` leaves out."""

    kind = documents.schema["doc_id"].dataType
    schema = pa.schema([
        ("doc_id", to_arrow_type(kind)), ("k", pa.int64()), ("n", pa.int64()), ("lost", pa.int64()), ("chunk", pa.string())])

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, text in _texts(batches):
            pieces, lost = briefs.cut(text or "", limit, cap)
            for k, piece in enumerate(pieces, 1):
                yield doc, k, len(pieces), lost, piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _bounded(pieces_of(batches), lambda row: len(row[4]), schema)

    return spread(documents.select("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, k long, n long, lost long, chunk string")
