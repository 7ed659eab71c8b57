"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared lower-cased, with runs of blanks as one space. An item of ``n`` characters may be matched
with up to ``rate * n`` edits; a region with ``e`` edits shares at least ``n + 1 - q * (e + 1)`` q-grams with the item,
on diagonals that lie at most ``e`` apart. Hits are counted in bands of ``2 * (e + 1)`` diagonals, which overlap by
half, so one band holds them all. The text of bands that reach the bound is aligned with the item, and kept if the edits
fit.

The benchmark is turned into a gram index that goes to every task. Its size is checked: a larger benchmark is cut into
blocks by a hash of the item, and the documents are read once per block. Documents are processed whole, long ones in
pieces that overlap by more than a region.

Nulls and odd cases: null and empty texts and items match nothing; an item whose budget would leave no shared gram gets
the largest budget that leaves one; items shorter than ``q`` are looked for as they are; repeated items and documents
each count; rows without id are compared like others; empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.base import query, table

Q = 10
RATE = 0.08
BLOCK_CHARS = 2_000_000
PIECE = 1 << 20
_TABLE_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalize(text: str) -> str:
    return " ".join(text.lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, size = codes.astype(np.uint64) * _MULTIPLIER, 1
    ones, power, total = out, _MULTIPLIER, out
    # Binary steps: the hash of a+b characters is hash(a) * M**b + hash(b).
    for bit in bin(q)[3:]:
        total = total[: len(total) - size] * _power(size) + total[size:]
        size *= 2
        if bit == "1":
            total = total[:-1] * power + ones[size : size + len(total) - 1]
            size += 1
    total = total[:n]
    return total ^ total >> np.uint64(31)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MULTIPLIER), n, 2**64))


def align(item: np.ndarray, text: np.ndarray, first: int, last: int) -> int:
    """Least edits of the item against any part of the text that diagonals ``first .. last`` reach. The differences down
    a column of the table of edits are the bits of two numbers (Myers), so a character of the text is a few operations."""
    size = len(item)
    places: dict[int, int] = {}
    for i, code in enumerate(item.tolist()):
        places[code] = places.get(code, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << size >> 1
    more, less, edits = full, 0, size
    best = edits
    for code in text[max(0, first) : max(0, last + size)].tolist():
        same = places.get(code, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | full & ~(across | more), more & across
        if up & top:
            edits += 1
        elif down & top:
            edits -= 1
            if edits < best:
                best = edits
                if not best:
                    break
        up, down, same = up << 1 & full, down << 1 & full, same | less
        more, less = down | full & ~(same | up), up & same
    return best


@dataclass
class Index:
    """Gram index of one block of items."""

    items: list[tuple[int | None, np.ndarray]]
    q: int = Q
    rate: float = RATE

    def __post_init__(self):
        sizes = np.array([len(codes) for _, codes in self.items], np.int64)
        self.sizes = sizes
        self.budget = np.maximum(0, np.minimum((self.rate * sizes).astype(np.int64), sizes // self.q - 1))
        self.needed = np.maximum(1, sizes + 1 - self.q * (self.budget + 1))
        hashes = [gram_hashes(codes, self.q) for _, codes in self.items]
        counts = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(self.items)), counts)
        place = np.concatenate([np.arange(c) for c in counts]) if len(counts) else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.short = [(i, codes) for i, (_, codes) in enumerate(self.items) if 0 < len(codes) < self.q]
        self.reach = int((sizes + 2 * self.budget).max(initial=0)) + self.q

    def find(self, text: str | None) -> dict[int, int]:
        """The items that match, with their least edits."""
        found: dict[int, int] = {}
        if not text or not self.items:
            return found
        plain = normalize(text)
        codes = points(plain)
        for i, item in self.short:
            if item.tobytes().decode("utf-32-le", "surrogatepass") in plain:
                found[i] = 0
        step = max(PIECE, 4 * self.reach)
        for at in range(0, max(1, len(codes) - 2 * self.reach), step):
            for i, edits in self._find(codes[at : at + step + 2 * self.reach]):
                found[i] = min(edits, found.get(i, edits))
        return found

    def _find(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return
        spot = np.searchsorted(self.grams, hashes[at])
        spot[spot == len(self.grams)] = 0
        same = self.grams[spot] == hashes[at]
        at, spot = at[same], spot[same]
        many = self.ends[spot] - self.starts[spot]
        if not many.sum():
            return
        each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts[spot], many)
        item, diagonal = self.owner[each], np.repeat(at, many) - self.place[each]
        step = self.budget[item] + 1
        band = diagonal // step
        base = int(band.min()) - 1
        span = int(band.max()) - base + 2
        keys = np.concatenate([item * span + band - base, item * span + band - 1 - base])
        keys, counts = np.unique(keys, return_counts=True)
        full = counts >= self.needed[keys // span]
        # An alignment within the budget lies in a full band, wherever it is found, so the bands of an item whose texts
        # touch are aligned as one, and the least edits are those of each by itself.
        stretches: dict[int, list[list[int]]] = {}
        for key in keys[full].tolist():
            i, b = key // span, key % span + base
            budget = int(self.budget[i])
            low, high = b * (budget + 1) - budget, (b + 2) * (budget + 1) + budget
            of_item = stretches.setdefault(i, [])
            if of_item and low <= of_item[-1][1] + int(self.sizes[i]):
                of_item[-1][1] = high
            else:
                of_item.append([low, high])
        for i, of_item in stretches.items():
            item = self.items[i][1]
            if _holds(codes, item):
                yield i, 0
                continue
            for low, high in of_item:
                if (edits := align(item, codes, low, high)) <= self.budget[i]:
                    yield i, edits


def _holds(text: np.ndarray, part: np.ndarray) -> bool:
    raw, wanted = text.tobytes(), part.tobytes()
    at = raw.find(wanted)
    while at % 4 and at >= 0:  # not at the start of a character
        at = raw.find(wanted, at + 1)
    return at >= 0


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **options) -> Iterator[Index]:
    """Indexes of at most about ``block_chars`` characters (one item is never cut)."""
    items = benchmark.select("item_id", "text").filter(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for block in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) if n > 1 else items
        yield Index([(r["item_id"], points(normalize(r["text"]))) for r in part.collect()], **options)


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, edits``: one row for every item that a document holds."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    parts = []
    for index in blocks(benchmark, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = [
                    (doc.as_py(), index.items[i][0], edits)
                    for doc, text in zip(batch.column(0), batch.column(1), strict=True)
                    for i, edits in sorted(index.find(text.as_py()).items())
                ]
                doc_ids, item_ids, edits = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, batch.schema.field(0).type), pa.array(item_ids, pa.int64()), pa.array(edits, pa.int32())],
                    names=["doc_id", "item_id", "edits"],
                )

        parts.append(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, edits int"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    spark = docs.sparkSession
    for index in blocks(benchmark, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not shared.value.find(t.as_py()) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
