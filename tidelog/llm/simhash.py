"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, each the majority of that bit over the hashes of the text's word shingles. Links: fingerprints
that differ in at most ``radius`` bits. Each bit gets a vector of ``radius + 1`` bits; table ``v`` keeps the bits whose
vector has odd parity with ``v``. At most ``radius`` differing bits give that many linear equations in one unknown
more, so some ``v`` other than 0 hides them all: every link collides in one of the ``2 ** (radius + 1) - 1`` tables.

Equal fingerprints are one node, whatever their number. A bucket of a table is walked breadth first over what is not
yet reached, and gives a spanning forest of its links (fewer than it has members) instead of its pairs; a group of
near copies empties at its first members. A bucket holds 8 bytes a member.

Nulls and odd cases: a null text, or one without words, has fingerprint zero and links like any other; fewer words
than a shingle are one shingle; null ids are fingerprinted and never become a component's id unless no other is there;
repeated rows are nodes like any; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.base import query, stage, table
from tidelog.llm.graph import components

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
_CHUNK = 1 << 14
_CELLS = 1 << 22


def simhash(data: bytes | None, shingle: int = SHINGLE) -> int:
    words = (data or b"").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    width = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    joined = b" ".join(words)
    total = len(words) - width + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, total, _CHUNK):
        until = min(total, at + _CHUNK)
        spans = zip(starts[at:until].tolist(), ends[at + width - 1 : until + width - 1].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, until - at)
        counts += set_bits(hashes)
    return majority(counts, total)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set."""
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
    return bits.sum(axis=0, dtype=np.int32)


def majority(counts: np.ndarray, total: int) -> int:
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def simhash_of(hashes: np.ndarray) -> int:
    """Fingerprint of shingles that are hashed already; zero without any."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        counts += set_bits(hashes[at : at + _CHUNK])
    return majority(counts, len(hashes))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, mark, fp``: the bits as a signed long, and a hash that tells texts of equal ids apart."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "mark", "fp"]
            )

    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return marked.mapInArrow(run, f"doc_id {kind}, mark long, fp long")


def cover_masks(radius: int = RADIUS, bits: int = BITS) -> np.ndarray:
    """One mask per table, as signed 64-bit integers."""
    top = (1 << (radius + 1)) - 1
    vectors = np.arange(bits) % top + 1
    masks = []
    for v in range(1, top + 1):
        odd = np.bitwise_count(vectors & v) % 2
        masks.append(sum(1 << i for i in range(bits) if odd[i]))
    return np.array(masks, np.uint64).view(np.int64)


def spanning_links(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (unsigned)."""
    links: list[tuple[int, int]] = []
    left = members
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            step = max(1, _CELLS // len(left))
            for at in range(0, len(front), step):
                part = front[at : at + step]
                near = np.bitwise_count(part[:, None] ^ left[None, :]) <= radius
                hit = near.any(axis=0)
                if hit.any():
                    parents = part[near[:, hit].argmax(axis=0)]
                    links.extend(zip(parents.tolist(), left[hit].tolist(), strict=True))
                    reached.append(left[hit])
                    left = left[~hit]
                if not len(left):
                    break
            front = np.concatenate(reached) if reached else left[:0]
    return links


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect all that lie within the radius."""
    masks = cover_masks(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(tables: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            shared = fps & masks[tables]
            cuts = np.flatnonzero((tables[1:] != tables[:-1]) | (shared[1:] != shared[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
            raw = fps.view(np.uint64)
            pair = starts[ends - starts == 2]
            pair = pair[np.bitwise_count(raw[pair] ^ raw[pair + 1]) <= radius]
            found = list(zip(raw[pair].tolist(), raw[pair + 1].tolist(), strict=True))
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                found.extend(spanning_links(raw[s:e], radius))
            ends_of = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends_of[:, 0]), pa.array(ends_of[:, 1])], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            t, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(t):
                continue
            shared = fp & masks[t]
            # All but the last bucket of the batch are complete.
            other = np.flatnonzero((t != t[-1]) | (shared != shared[-1]))
            if held and not len(other):
                last_t, last_fp = held[-1][0][-1], held[-1][1][-1]
                if t[0] == last_t and shared[0] == last_fp & masks[last_t]:
                    held.append((t, fp))
                    continue
            split = other[-1] + 1 if len(other) else 0
            done_t = np.concatenate([x[0] for x in held] + [t[:split]])
            done_fp = np.concatenate([x[1] for x in held] + [fp[:split]])
            if len(done_t):
                yield links_of(done_t, done_fp)
            held = [(t[split:], fp[split:])]
        if held:
            yield links_of(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

    spread = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"), "fp")
    shared = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(int(m)) for m in masks]), F.col("t") + 1))
    dealt = spread.repartition("t", shared).sortWithinPartitions("t", shared)
    return dealt.mapInArrow(run, "a long, b long")


def link_documents(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, mark, fp, component_id`` of every document; the component id is the least document id reachable."""
    fps = stage(fingerprints(docs, shingle))
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = stage(components(near_links(nodes, radius)))
    named = roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "rep")
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("least"))
    linked = named.join(least, F.col("root") == F.col("r")).select("node", "least")
    final = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        F.col("fp").alias("__fp"), F.coalesce("least", "rep").alias("component_id")
    )
    return fps.join(final, F.col("fp") == F.col("__fp")).drop("__fp")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_documents(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
