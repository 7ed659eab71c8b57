"""Document fingerprints: a quartile digest over buckets of hashed byte triplets.

Within a window of five bytes, six triplets that hold the first byte are hashed, each form with its own salt, into
``BUCKETS`` buckets. The quartiles of the bucket counts give every bucket a level from 0 to 3; the digest is the
logarithmic length and these levels, two bits each, as text. Two digests differ by the sum of their level distances
(a distance of 3 counts double, as it is rarely chance) plus the distance of their lengths; the likeness is 1 at no
difference and 0 from ``FAR`` on, which unlike texts reach.

Chains: ``next_texts`` gives every document its successor in descending order of id without a global sort of texts.
Ids are cut into ranges at sampled quantiles, each range is ordered in one partition, and the first document of each
range is sent to the range before it as well, so each text moves once.

Nulls and odd cases: null text is empty; texts of fewer than three bytes have no triplets and share one digest per
length class; null ids come last in the order; equal ids follow in an order fixed by their texts; the successor of a single document is
itself; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.base import query, stage, table

BUCKETS = 256
#: Offsets of the second and third byte of the triplets that begin a window of five.
FORMS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
FAR = 1.0 * BUCKETS
LENGTH_BASE = 1.1
RANGES_PER_PARTITION = 2
_BLOCK = 1 << 18


def fingerprint(data: bytes) -> str:
    """Two hexadecimal digits of length class, then two bits a bucket."""
    raw = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(raw) - 2), _BLOCK):
        part = raw[at : at + _BLOCK + 4].astype(np.uint32)
        for salt, (i, j) in enumerate(FORMS):
            n = min(_BLOCK, len(part) - j)
            if n <= 0:
                continue
            mixed = part[:n] + (part[i : i + n] << np.uint32(8)) + (part[j : j + n] << np.uint32(16))
            mixed += np.uint32(salt * 0x1000193)
            mixed *= np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            counts += np.bincount((mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=BUCKETS)
    size = 0 if not len(raw) else min(255, 1 + int(np.log(len(raw)) / np.log(LENGTH_BASE)))
    levels = np.zeros(BUCKETS, np.uint8)
    if counts.any():
        ordered = np.sort(counts)
        for quarter in (1, 2, 3):
            levels += counts > ordered[quarter * BUCKETS // 4 - 1]
    four = levels.reshape(-1, 4)
    packed = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return f"{size:02x}" + packed.astype(np.uint8).tobytes().hex()


def _levels(digest: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return int(raw[0]), (raw[1:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(-1).astype(np.int16)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for those that differ by ``FAR`` or more."""
    size_a, levels_a = _levels(a)
    size_b, levels_b = _levels(b)
    apart = np.abs(levels_a - levels_b)
    difference = int(apart.sum()) + 3 * int((apart == 3).sum()) + max(0, abs(size_a - size_b) - 1)
    return 1.0 - min(1.0, difference / FAR)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, compute, schema: str) -> DataFrame:
    """Run ``compute(doc_id, text, next_text)`` on every document and its successor by descending id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(2, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A bounded number of cuts, from the ids alone. Ranges are numbered in descending order of id.
    cuts = docs.filter(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    own = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(
        F.size(F.filter(bounds, lambda c: c > F.col("doc_id")))
    ).cast("int")
    placed = docs.withColumn("range", own)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    # The first document of each range: at most as many rows as ranges, and without their texts.
    heads = placed.groupBy("range").agg(F.max("doc_id").alias("head"))
    around = Window.orderBy("range")
    heads = stage(
        heads.withColumn("to", F.coalesce(F.lag("range").over(around), F.max("range").over(Window.partitionBy())))
    ).select(F.col("range").alias("__r"), F.col("head").alias("__h"), F.col("to").alias("__to"))
    met = placed.join(
        F.broadcast(heads), (F.col("range") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__h")), "left"
    )
    # Heads go to the range before as well (the first one's to the last), behind its own documents.
    sent = met.select(
        F.explode(
            F.when(F.col("__to").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))))
            .otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")),
                               F.struct(F.col("__to").alias("range"), F.lit(1).alias("guest"))))
        ).alias("at"), "doc_id", "text",
    ).select("at.range", "at.guest", "doc_id", "text")
    dealt = sent.repartition("range").sortWithinPartitions("range", "guest", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = []
            for at, guest, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if before is not None and before[0] == at:
                    rows.append(compute(before[1], before[2], text))
                before = None if guest else (at, doc_id, text)
            yield rows_to_batch(rows)

    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    target = pa.schema([(name, kinds.get(kind, pa.int64())) for name, kind in fields])

    def rows_to_batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return dealt.mapInArrow(run, schema)


_last: dict[str, str] = {}


def _text_fingerprint(text: str) -> str:
    """The successor of a document is the next one asked for, so the last fingerprint is kept."""
    if text not in _last:
        found = fingerprint(text.encode("utf-8", "surrogatepass"))
        _last.clear()
        _last[text] = found
    return _last[text]


def compare_next(doc_id, text: str, following: str) -> tuple:
    changed = edited(text, following)
    own, after = _text_fingerprint(text), _text_fingerprint(following)
    other = fingerprint(changed.encode("utf-8", "surrogatepass"))
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own, other, likeness(own, other), likeness(own, after)


@query("op2_digest")
def op2_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(
        table(spark, sf_dir, "documents"), compare_next,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
