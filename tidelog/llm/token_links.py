"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each tokenizer gives a text token ids whose bytes, joined, are the text. The byte ends of both are kept as dictionaries
from end to index; the ends that both know cut the two id lists into groups, and every token of one side of a group is
linked with every token of its other side. A large group is linked by its different ids and their counts, not pair by pair.

Neither tokenizer has a token that goes on from a letter over a blank, so a text is a row of segments, each a blank and
what follows it; both sides end at their borders. What a segment gives is kept in the worker, as words recur, and only
those that are new to it are encoded and aligned, all of a text at once. That borders hold is tried out as the tokenizers
are loaded; a pair for which they do not, or a text with a long segment, is taken whole.

Corpus-wide, the count of an id pair is the number of documents that hold it linked. Documents are read once, in blocks:
a block writes its documents with their pairs, and one row for each different pair with the number of its documents. The
counts are sums over these rows, and go back to each block that has the pair, where its documents look them up. What
moves is a row for each pair a block, not for each pair a document.

The files of the tokenizers are read on the driver, and go to the tasks as their bytes (2 MB for the two of the query).
The byte-level BPE is run by ``tiktoken`` on the vocabulary and merges of the given ``tokenizers`` file: its ids follow
the order of the merges (checked as it is loaded), which makes both the same encoding, and it takes a quarter of the time.

Nulls and odd cases: null and empty texts have no tokens, nor have texts that are no UTF-8, or whose tokens of either side
do not join to the text; such documents have zeros and an empty digest. Null ids are documents like others; repeated rows
count as documents of their own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.base import query, stage, table

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How a byte-level BPE cuts text before it merges. A fixed value of that format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of documents after which a block ends; documents a batch of the output; links of a group that are expanded one by one.
BLOCK_PAIRS = 1 << 20
STEP = 64
EXPANDED = 64
#: Longest segment of texts that are taken by segments, and how many a worker keeps (two times, newer and older).
KEPT_CHARS, KEPT_SEGMENTS = 200, 1 << 17
_BLANK_AFTER_SPACE = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The byte of every letter of byte-level vocabularies: printable bytes stand for themselves, others follow 255."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Two loaded tokenizers: encoders of text, and the bytes of their ids."""

    def __init__(self, file_a: bytes, file_b: bytes) -> None:
        model = json.loads(file_a)["model"]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in entry): i for entry, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("the ids of the vocabulary do not follow its merges")
        self._a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        self.bytes_a: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes_a[i] = raw
        ids_b = range(self._b.get_piece_size())
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self._b.id_to_piece(i)) for i in ids_b)
        ]
        self.width_a, self.width_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # Names of ids before another of their group, and at the end of their side of it.
        self.names = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(ids_b), ",;")) for i in range(n) for end in ends]
        pieces = (self._b.id_to_piece(i).lstrip("▁") for i in ids_b)
        self.by_segment = not any("▁" in p for p in pieces) and all(map(self._cut_alike, (
            "a", " a  b \n c  d\te ", "\n x\n\n y ", "e é  中 ", "a\n b\n  c", "　 x 　")))
        # Newer and older segments: what is asked for again comes to the newer ones, what is not goes with the older.
        # A blank alone, which B would take for an empty text, is always known.
        only = Alignment(self, self._a.encode_ordinary(" "), [self._b.piece_to_id("▁")])
        self._new: dict[str, Segment] = {}
        self._old: dict[str, Segment] = {}
        self._blank = only.cut(np.ones(1, np.int64))[0]

    def _encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a blank and the text; None where they do not join to it."""
        a, b, whole = self._a.encode_ordinary(" " + text), self._b.encode(text), b" " + text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
        return (a, b) if same else None

    def _cut_alike(self, text: str) -> bool:
        """Whether segments, and several that are no neighbours, have the ids that they have in the text."""
        parts = segments(text)
        apart = [self._encode(p) if p else (self._a.encode_ordinary(" "), [self._b.piece_to_id("▁")]) for p in parts]
        some = [k for k in range(len(parts)) if k % 2 or not parts[k]]
        return all(
            got is not None and all(got[side] == sum((apart[k][side] for k in which), []) for side in (0, 1))
            for got, which in ((self._encode(text), range(len(parts))),
                               (self._encode(" ".join(parts[k] for k in some)), some)) if any(parts[k] for k in which)
        )

    def align(self, raw: bytes) -> Aligned | None:
        """What a text gives; None where there are no tokens."""
        text = _decoded(raw)
        if not text or "▁" in text:  # that letter stands for a blank on the side of B
            return None
        if self.by_segment:
            parts = segments(text)
            if max(map(len, parts)) <= KEPT_CHARS:
                return self._by_segment(parts)
        ids = self._encode(text)
        return None if ids is None else Alignment(self, *ids).whole()

    def _by_segment(self, parts: list[str]) -> Aligned | None:
        if len(self._new) >= KEPT_SEGMENTS:
            self._old, self._new = self._new, {}
        missing = set(parts).difference(self._new)
        if missing and not self._learn(missing, parts[-1]):
            return None
        groups, codes, n_a, n_b = zip(*map(self._new.__getitem__, parts))
        text, links = "".join(groups)[:-1], np.frombuffer(b"".join(codes), np.int64)
        pairs, times = np.unique(links, return_counts=True)
        return Aligned(text, pairs, times, sum(n_a), sum(n_b), text.count(";") + 1, len(links))

    def _learn(self, parts: set[str], last: str) -> bool:
        """Puts segments among the newer ones; those that are new to the worker are encoded and aligned at once. A segment
        that ends in white space is the ``last`` of its text, and stays the last."""
        fresh = [p for p in parts if p not in self._old and p and p != last]
        if last in parts and last and last not in self._old:
            fresh.append(last)
        self._new.update((p, self._old[p]) for p in parts.difference(fresh) if p)
        if "" in parts:
            self._new[""] = self._blank
        if fresh:
            ids = self._encode(" ".join(fresh))
            if ids is None:
                return False
            ends = np.cumsum([len(p.encode()) + 1 for p in fresh])
            self._new.update(zip(fresh, Alignment(self, *ids).cut(ends), strict=True))
        return True


def segments(text: str) -> list[str]:
    """A text with a blank before it, cut before every blank that follows on what is no white space; without these blanks."""
    parts = text.split(" ")
    if not text.startswith(" ") and not _BLANK_AFTER_SPACE.search(text):
        return parts
    merged, held = [], None
    for p in parts:
        held = p if held is None else f"{held} {p}"
        if held and not held[-1].isspace():
            merged.append(held)
            held = None
    return merged if held is None else [*merged, held]


#: Of a segment: its groups as text (each with the sign that ends it), the bytes of its linked pairs (one for each link),
#: and its numbers of tokens.
Segment = tuple[str, bytes, int, int]


class Aligned(NamedTuple):
    """Groups as text, different pairs in order, how often each is linked, and counts of a text."""

    groups: str
    pairs: np.ndarray
    times: np.ndarray
    n_a: int
    n_b: int
    n_groups: int
    n_links: int


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(codes, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, where, times)
    return keys, total


def _decoded(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return ""


@lru_cache(maxsize=2)
def _loaded(file_a: bytes, file_b: bytes) -> Pair:
    """One pair a Python worker, whatever the number of tasks it runs."""
    return Pair(file_a, file_b)


class Alignment:
    """Groups and links of two id lists whose tokens join to the same bytes."""

    def __init__(self, pair: Pair, a: list[int], b: list[int]) -> None:
        self.a, self.b, self.pair = np.array(a, np.int64), np.array(b, np.int64), pair
        ends_a = dict(zip(np.cumsum(pair.width_a[self.a]).tolist(), count(1)))
        ends_b = dict(zip(np.cumsum(pair.width_b[self.b]).tolist(), count(1)))
        common = sorted(ends_a.keys() & ends_b.keys())
        self.ends = np.array(common, np.int64)
        self.end_a = np.fromiter(map(ends_a.__getitem__, common), np.int64, len(common))
        self.end_b = np.fromiter(map(ends_b.__getitem__, common), np.int64, len(common))
        self.size_a, self.size_b = np.diff(self.end_a, prepend=0), np.diff(self.end_b, prepend=0)
        self.links = self.size_a * self.size_b

    def _names(self) -> list[str]:
        """All ids in order of their groups, each with what follows it in ``a1,a2|b1;a3|b2,b3;``."""
        start_b = self.end_b - self.size_b
        ends_a, ends_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        ends_a[self.end_a - 1] = ends_b[self.end_b - 1] = 1
        order = np.empty(len(self.a) + len(self.b), np.int64)
        # Before a token of A stand the B tokens of earlier groups, before one of B the A tokens up to its own group.
        order[np.arange(len(self.a)) + np.repeat(start_b, self.size_a)] = 2 * self.a + ends_a
        order[np.arange(len(self.b)) + np.repeat(self.end_a, self.size_b)] = 2 * (len(self.pair.bytes_a) + self.b) + ends_b
        return list(map(self.pair.names.__getitem__, order.tolist()))

    def _codes(self, some: np.ndarray) -> np.ndarray:
        """The links of some groups, in order, as ``a * size of B's vocabulary + b``."""
        size = self.links[some]
        group = np.repeat(some, size)
        place = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        at_a = (self.end_a - self.size_a)[group] + place // self.size_b[group]
        at_b = (self.end_b - self.size_b)[group] + place % self.size_b[group]
        return self.a[at_a] * len(self.pair.bytes_b) + self.b[at_b]

    def cut(self, ends: np.ndarray) -> list[Segment]:
        """The stretches that end at these bytes, which both sides know as ends. For short ones: links are listed."""
        group = np.searchsorted(self.ends, ends)
        to_a, to_b, to_link = self.end_a[group], self.end_b[group], 8 * np.cumsum(self.links)[group]
        names, codes = self._names(), self._codes(np.arange(len(self.ends))).tobytes()
        out, name, link, a, b = [], 0, 0, 0, 0
        for x, y, z in zip(to_a.tolist(), to_b.tolist(), to_link.tolist(), strict=True):
            out.append(("".join(names[name : x + y]), codes[link:z], x - a, y - b))
            name, link, a, b = x + y, z, x, y
        return out

    def whole(self) -> Aligned:
        """All of it as one text, which may be long: a large group is linked by its different ids and their counts."""
        width = len(self.pair.bytes_b)
        keys, times = np.unique(self._codes(np.flatnonzero(self.links <= EXPANDED)), return_counts=True)
        more, counts = [keys], [times]
        for g in np.flatnonzero(self.links > EXPANDED):
            of_a, n_a = np.unique(self.a[self.end_a[g] - self.size_a[g] : self.end_a[g]], return_counts=True)
            of_b, n_b = np.unique(self.b[self.end_b[g] - self.size_b[g] : self.end_b[g]], return_counts=True)
            more.append((of_a[:, None] * width + of_b).ravel())
            counts.append((n_a[:, None] * n_b).ravel())
        if len(more) > 1:
            keys, times = _summed(np.concatenate(more), np.concatenate(counts))
        return Aligned("".join(self._names())[:-1], keys, times, len(self.a), len(self.b), len(self.ends), int(self.links.sum()))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int64), *arrays]))


def read_files(folder: str, *names: str) -> tuple[bytes, ...]:
    """Whole tokenizer files, read on the driver."""
    found = []
    for name in names:
        with open(os.path.join(folder, name), "rb") as f:
            found.append(f.read())
    return tuple(found)


def linked_blocks(docs: DataFrame, files: tuple[bytes, bytes], block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Rows of documents (``kind`` 1: counts, digest, and their pairs with the number of links of each) and of blocks
    (``kind`` 0: their pairs with the number of documents of each)."""
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(files)
    names = ["block", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    schema = (f"block long, kind int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
              "groups_sha256 string, pairs array<long>, times array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _loaded(*sent.value)
        block, held, of_block = TaskContext.get().partitionId() << 32, 0, []
        none = np.empty(0, np.int64)
        id_type = None

        def batch_of(kind: int, ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            figures = list(zip(*rows, strict=True))
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), ids,
                 *[pa.array(c, pa.int64()) for c in figures[:4]], pa.array(figures[4], pa.string()),
                 _lists(figures[5]), _lists(figures[6])], names=names)

        def ended() -> pa.RecordBatch:
            pairs, docs_of = np.unique(np.concatenate(of_block), return_counts=True)
            return batch_of(0, pa.nulls(1, id_type), [(0, 0, 0, 0, "", pairs, docs_of)])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, STEP):
                ids, texts = batch.column(0).slice(at, STEP), batch.column(1).slice(at, STEP)
                rows = []
                for t in texts:
                    found = tokenizers.align(t.as_py() or b"")
                    if found is None:
                        rows.append((0, 0, 0, 0, "", none, none))
                        continue
                    digest = hashlib.sha256(found.groups.encode()).hexdigest()
                    rows.append((found.n_a, found.n_b, found.n_groups, found.n_links, digest, found.pairs, found.times))
                    of_block.append(found.pairs)
                    held += len(found.pairs)
                yield batch_of(1, ids, rows)
                if held >= block_pairs:
                    yield ended()
                    block, held, of_block = block + 1, 0, []
        if of_block:
            yield ended()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def align(docs: DataFrame, folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    files = read_files(folder, file_a, file_b)
    width = len(Pair(*files).bytes_b)
    kind = dict(docs.dtypes)["doc_id"]
    blocks = stage(linked_blocks(docs, files, block_pairs))
    of_blocks = blocks.filter("kind = 0").select("block", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed(
        {"pairs": "pair", "times": "n"})
    counts = stage(of_blocks.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a", F.expr(f"pair div {width}")))
    # One row for each id of A at most, so never more rows than its vocabulary has entries.
    top = counts.groupBy(F.col("a").alias("__a")).agg(F.max("n_docs").alias("top"))
    known = counts.join(F.broadcast(top), F.col("a") == F.col("__a")).select(
        F.col("pair").alias("__pair"), "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))
    told = of_blocks.join(known, F.col("pair") == F.col("__pair")).select("block", F.lit(0).alias("kind"), "pair", "n_docs", "best")
    both = told.unionByName(blocks.filter("kind = 1"), allowMissingColumns=True)
    order = ["block", "kind", "pair", "n_docs", "best", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    dealt = both.select(*order).repartition("block").sortWithinPartitions("block", "kind", "pair")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, pairs, n_docs, best = None, [], None, None, None
        for batch in batches:
            place, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if start == end:
                    continue
                some = batch.slice(start, end - start)
                if place[start] != block:
                    block, parts, pairs = place[start], [], None
                if kinds[start] == 0:
                    parts.append([some.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)])
                    continue
                if pairs is None:
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.empty(0, np.int64)] * 3
                    pairs, n_docs, best = columns[0], columns[1], columns[2].astype(np.int64)
                lists, times = some.column(11), some.column(12)
                ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
                # A block's pairs are all known, so the place found is that of the pair itself.
                at = np.searchsorted(pairs, lists.flatten().to_numpy())
                weight = times.flatten().to_numpy()
                sums = [np.concatenate(([0], np.cumsum(weight * of[at])))[ends] for of in (best, n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c) for c in range(5, 11)], *[pa.array(np.diff(s)) for s in sums]], names=names)

    out = dealt.mapInArrow(
        look_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op11_token_links")
def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
