"""Fill-in-middle: a document becomes prefix, suffix and middle in an order that teaches a model to fill gaps.

A text is cut into lines (a newline ends its line). Where lines end is found on words of eight bytes: the text is viewed
as ``uint64``, arithmetic within a word marks the bytes that end a line, a bit count gives the ends of every word and
their running sum finds the word of the k-th end; the end inside it is found by clearing lower marks. The cut points and
the form are drawn from the SHA-256 of seed and id, so reruns agree and every document stands alone.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``, ``plain`` the text itself.
No text that holds a marker is cut, so ``restored`` finds the parts again in the output.

Nulls and odd cases: null counts as empty; empty texts are plain with no lines; a text without a newline is one line; a
null id draws from the seed alone; repeated rows give repeated results; an empty table gives an empty result. Bytes that
are no UTF-8 are carried as they are. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.base import query, table

SEED = 7
#: Of 100 documents so many are cut, and of those so many take the form ``spm``.
RATE, SPM_RATE = 100, 50
MARKERS = (b"<P>", b"<S>", b"<M>")
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
#: Bytes of output in one Arrow batch, but for a single longer one.
_BATCH_BYTES = 1 << 25


class LineEnds:
    """Where the lines of a text end. ``count`` is their number; ``end(k)`` the byte after the k-th, 0 for none."""

    def __init__(self, data: bytes) -> None:
        self.size = len(data)
        words = np.frombuffer(data + bytes(-len(data) % 8), "<u8")
        # A byte of x is zero where the text has a newline; adding carries into the top bit of all others.
        x = words ^ _NEWLINES
        self.marks = ~(((x & _LOW) + _LOW) | x | _LOW)
        self.until = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)
        self.newlines = int(self.until[-1]) if len(words) else 0
        self.count = self.newlines + (self.size > 0 and not data.endswith(b"\n"))

    def end(self, k: int) -> int:
        if k == 0:
            return 0
        if k > self.newlines:
            return self.size
        word = int(np.searchsorted(self.until, k))
        mark = int(self.marks[word])
        for _ in range(k - 1 - (int(self.until[word - 1]) if word else 0)):
            mark &= mark - 1
        return 8 * word + ((mark & -mark).bit_length() - 1) // 8 + 1


def draws(doc_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def rearranged(
    doc_id: object, data: bytes, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE
) -> tuple[int, str, int | None, int | None, bytes]:
    """``n, form``, the characters of prefix and middle, and the output."""
    ends = LineEnds(data)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= rate or any(m in data for m in MARKERS):
        return ends.count, "plain", None, None, data
    first, second = sorted((h1 % (ends.count + 1), h2 % (ends.count + 1)))
    a, b = ends.end(first), ends.end(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = MARKERS
    spm = h4 % 100 < spm_rate
    output = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    # Code points: the bytes that continue none.
    leads = (np.frombuffer(data, np.uint8)[:b] & 0xC0) != 0x80
    in_prefix = int(np.count_nonzero(leads[:a]))
    return ends.count, "spm" if spm else "psm", in_prefix, int(np.count_nonzero(leads)) - in_prefix, output


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            at = held = 0
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                rows.append(rearranged(ids[i].as_py(), texts[i].as_py() or b"", seed, rate, spm_rate))
                held += len(rows[-1][-1])
                if held >= _BATCH_BYTES or i + 1 == batch.num_rows:
                    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), *made], names=names)
                    at, held, rows = i + 1, 0, []

    cut = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    )
    return cut.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    p, s, m = (x.decode() for x in MARKERS)

    def parts(between: str) -> tuple[Column, Column, Column]:
        """What stands before ``between`` (behind the first marker), after it, and after the last marker."""
        tail = F.substring_index(output, between, -1)
        head = F.substring(F.substring_index(output, between, 1), len(p) + 1, 2147483647)
        return head, F.substring_index(tail, m, 1), F.substring_index(tail, m, -1)

    prefix, suffix, middle = parts(s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(p)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1,
         CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2, CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3,
         CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(units[1:a], ''), '') AS x, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(units[b + 1:n], ''), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN concat('<P>', x, '<S>', s, '<M>', m) WHEN 'spm' THEN concat('<S>', s, '<P>', x, '<M>', m)
              ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@query("op12_fill_in_middle", SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
