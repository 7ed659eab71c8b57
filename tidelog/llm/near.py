"""Near copies by SimHash fingerprints, MinHash bands and exact Jaccard similarity of five-word shingles.

A document is the set of its shingles (``SHINGLE`` words, ASCII letters in lower case; fewer words than that are one
shingle). Documents of equal sets (by 128 bits of hash) are one node. Nodes are linked by the method of
:mod:`tidelog.llm.simhash`: the fingerprint is the majority over the set's shingles, equal fingerprints and those within its
radius are found by its covering tables, and a link counts if the exact similarity is ``SIMILAR`` or more. At 0.8 most
fingerprints differ in more bits than tables can cover, so what fingerprints leave apart meets by bands: a node has ``BANDS`` band hashes of ``ROWS`` minima
each; two sets of similarity ``s`` share a band but for a chance of ``(1 - s ** ROWS) ** BANDS``, 3 in a million at 0.8.
Nothing that shares a band is linked unless its exact similarity is ``SIMILAR`` or more.

Members of a bucket are first compared with a few leaders alone, at most ``LEADERS`` pairs a member, which joins families
of near copies without their pairs. Members that lie in different groups after that meet inside tasks: a bucket is cut
into blocks of about ``BLOCK`` members, and block is held against block by signatures of ``BITS`` minima of one bit each.
Only pairs whose signatures come near the bound leave the task, at first the ``PARTNERS`` nearest of a member and in later
rounds more, until none is left untried. A pair at 0.8 falls short of ``NEAR`` with a chance of 2 in 10,000.

Nulls and odd cases: null texts and texts without words are one node; repeated rows are rows of one node; null ids are
documents like others; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import simhash
from tidelog.llm.base import stage
from tidelog.llm.graph import components

SHINGLE = 5
#: Similarity as a fraction of whole numbers, so that the bound is exact.
SIMILAR = (4, 5)
BANDS, ROWS = 24, 4
LEADERS = 3
BITS, BLOCK, PARTNERS = 2048, 2048, 4
#: 0.8 less 3.5 standard deviations of a similarity that is estimated from so many bits.
NEAR = 0.8 - 3.5 * 2 * math.sqrt(0.9 * 0.1 / BITS)
SEED = 42
_CHUNK, _SIGN_CHUNK = 1 << 12, 1 << 8
#: Pairs of members that are held against each other at a time.
_CELLS = 1 << 20
_MULTIPLY, _ADD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_MULTIPLY |= np.uint64(1)
_FOLD = np.random.default_rng(SEED + 1).integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_SIGN_MULTIPLY, _SIGN_ADD, _SIGN_FOLD = np.random.default_rng(SEED + 2).integers(0, 1 << 64, (3, BITS), np.uint64)
_SIGN_MULTIPLY |= np.uint64(1)
_SIGN_FOLD |= np.uint64(1)


def shingle_set(data: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles."""
    words = (data or b"").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.empty(0, np.uint64)
    width = min(SHINGLE, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(words) - width + 1))


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(shingles.tobytes(), SEED)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _minima(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray, chunk: int) -> np.ndarray:
    least = np.full(len(multiply), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), chunk):
        part = shingles[at : at + chunk, None] * multiply + add
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """One hash per band; none without shingles."""
    if not len(shingles):
        return shingles
    least = _minima(shingles, _MULTIPLY, _ADD, _CHUNK).reshape(BANDS, ROWS)
    # Each band has factors of its own, so equal minima of different bands do not meet.
    return ((least ^ (least >> np.uint64(29))) * _FOLD).sum(axis=1, dtype=np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """One bit of each of ``BITS`` minima: sets of similarity ``s`` agree in ``(1 + s) / 2`` of them, or nearly so."""
    least = _minima(shingles, _SIGN_MULTIPLY, _SIGN_ADD, _SIGN_CHUNK)
    return np.packbits((((least ^ (least >> np.uint64(29))) * _SIGN_FOLD) >> np.uint64(63)).astype(np.uint8)).tobytes()


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns, nulls told apart; equal for rows that are repeats of each other. Columns that hold maps,
    which have no hash, are hashed as JSON."""
    hashed = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    return F.xxhash64(*hashed, *[F.col(c).isNull() for c in docs.columns])


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, row, high, low, fp, bands`` of every row: hashes of its text and of all its columns, its set, its
    fingerprint and its bands."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(3)]
            named = np.array([node_of(s) for s in sets], np.int64).reshape(-1, 2)
            prints = np.array([simhash.simhash_of(s) for s in sets], np.uint64).view(np.int64)
            bands = [band_hashes(s).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(named[:, 0]), pa.array(named[:, 1]), pa.array(prints),
                 pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "row", "high", "low", "fp", "bands"],
            )

    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), row_hash(docs).alias("row"), F.col("text").cast("binary"))
    return marked.mapInArrow(run, f"doc_id {kind}, mark long, row long, high long, low long, fp long, bands array<long>")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b`` of nodes (``node, fp``) that fingerprints link: each node with the one that stands for its fingerprint, and
    those of fingerprints that :func:`tidelog.llm.simhash.near_links` links."""
    firsts = stage(nodes.groupBy(F.col("fp").alias("print")).agg(F.min("node").alias("first")))
    equal = nodes.join(firsts, F.col("fp") == F.col("print")).filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = stage(simhash.near_links(firsts.select(F.col("print").alias("fp"))).distinct())
    left = firsts.select(F.col("print").alias("x"), F.col("first").alias("one"))
    right = firsts.select(F.col("print").alias("y"), F.col("first").alias("two"))
    near = links.join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y")).select(
        F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    return stage(equal.unionByName(near).distinct())


def shingle_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, body`` of ``nodes`` (``node``, and ``row, mark`` of a row that stands for it): the bytes of each set."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "body"])

    picked = nodes.select("node", F.col("row").alias("__row"), F.col("mark").alias("__mark"))
    keyed = docs.select(F.col("text").cast("binary").alias("text"), row_hash(docs).alias("row"), F.xxhash64("text").alias("mark"))
    met = keyed.join(picked, (F.col("row") == F.col("__row")) & (F.col("mark") == F.col("__mark"))).select("node", "text")
    return stage(met.mapInArrow(sets_of, "node long, body binary").dropDuplicates(["node"]))


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of nodes (``a, b``) whose sets are similar."""
    top, bottom = SIMILAR

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                few, most = sorted((len(one), len(two)))
                fits = few * bottom >= most * top
                shared = len(np.intersect1d(one, two, assume_unique=True)) if fits else 0
                alike.append(shared * (top + bottom) >= (few + most) * top)
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    left = sets.select(F.col("node").alias("x"), F.col("body").alias("a_body"))
    right = sets.select(F.col("node").alias("y"), F.col("body").alias("b_body"))
    both = pairs.join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y"))
    return stage(both.select("a", "b", "a_body", "b_body").mapInArrow(compare, "a long, b long"))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal values in the first ``keys`` columns, as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_partners(signs: np.ndarray, roots: np.ndarray, others: np.ndarray, other_roots: np.ndarray, partners: int):
    """``i, j, more``: places of members and of up to ``partners`` nearest others in different groups whose signatures
    come near the bound, and whether that member has more of them."""
    bound = math.ceil(BITS * (1 + NEAR) / 2)
    for at in range(0, len(signs), step := max(1, _CELLS // max(1, len(others)))):
        part = signs[at : at + step]
        apart = np.zeros((len(part), len(others)), np.int32)
        for w in range(signs.shape[1]):
            apart += np.bitwise_count(part[:, w, None] ^ others[None, :, w])
        alike = np.where(roots[at : at + step, None] == other_roots[None, :], 0, BITS - apart)
        for i in np.flatnonzero((alike >= bound).any(axis=1)):
            found = np.flatnonzero(alike[i] >= bound)
            more = len(found) > partners
            if more:
                found = found[np.argsort(-alike[i, found], kind="stable")[:partners]]
            for j in found:
                yield at + i, j, more


def open_pairs(members: DataFrame, sets: DataFrame, partners: int) -> DataFrame:
    """``a, b, more`` of members (``band, node, root``) that share a bucket, lie in different groups and may be similar."""
    members = stage(members)
    split = members.groupBy(F.col("band").alias("__band")).agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    blocks = split.select("__band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = stage(members.join(blocks, F.col("band") == F.col("__band")).drop("__band"))
    if met.isEmpty():
        return met.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(False).alias("more"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [signature(np.frombuffer(v.as_buffer(), np.uint64)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.binary())], names=["__node", "sign"])

    wanted = met.select(F.col("node").alias("__node")).distinct()
    signed = stage(sets.join(wanted, F.col("node") == F.col("__node"), "left_semi").mapInArrow(sign, "__node long, sign binary"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = met.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = spread.select("band", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "root")
    placed = placed.join(signed, F.col("node") == F.col("__node")).drop("__node")
    dealt = placed.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 3):
            one, two, own, node, root = (batch.column(c).to_numpy() for c in range(1, 6))
            signs = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(len(node), -1)
            left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
            found = list(near_partners(signs[left], root[left], signs[right], root[right], partners))
            if found:
                i, j, more = map(np.array, zip(*found, strict=True))
                x, y = node[left[i]], node[right[j]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(more)], names=["a", "b", "more"])

    return stage(dealt.mapInArrow(compare, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more")))


def group_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, row, group`` of every row: documents linked by similarity, over any number of links, share a group."""
    rows = stage(sketches(docs))
    # Sets are numbered as they are written: a number is one set's for good.
    nodes = stage(rows.dropDuplicates(["high", "low"]).select(
        "high", "low", "row", "mark", "fp", "bands", F.monotonically_increasing_id().alias("node")))
    printed = print_pairs(nodes.select("node", "fp"))
    members = stage(nodes.select("node", F.explode("bands").alias("band")))
    leaders = [F.min_by("node", F.xxhash64(F.lit(k), "node")).alias(f"l{k}") for k in range(LEADERS)]
    buckets = members.groupBy(F.col("band").alias("__band")).agg(F.count("*").alias("n"), *leaders).filter("n > 1")
    shared = stage(members.join(buckets, F.col("band") == F.col("__band")).drop("__band", "n"))
    met = shared.select(F.col("node").alias("__node")).unionByName(printed.select(
        F.explode(F.array("a", "b")).alias("__node"))).distinct()
    sets = shingle_sets(nodes.join(met, F.col("node") == F.col("__node"), "left_semi"), docs)
    led = shared.select("node", F.explode(F.array(*[f"l{k}" for k in range(LEADERS)])).alias("lead")).filter("node <> lead")
    tried = stage(led.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).unionByName(printed).distinct())
    links = similar_pairs(tried, sets)
    partners = PARTNERS
    while True:
        roots = stage(components(links)).withColumnRenamed("node", "__node")
        rooted = shared.select("node", "band").join(roots, F.col("node") == F.col("__node"), "left")
        found = open_pairs(rooted.select("band", "node", F.coalesce("root", "node").alias("root")), sets, partners)
        fresh = stage(found.select("a", "b").join(tried, ["a", "b"], "left_anti"))
        more, none = not found.filter("more").isEmpty(), fresh.isEmpty()
        if not none:
            links = stage(links.unionByName(similar_pairs(fresh, sets)))
            tried = stage(tried.unionByName(fresh))
        if not more:
            break
        partners *= 4
    if not none:
        roots = stage(components(links)).withColumnRenamed("node", "__node")
    known = nodes.select(F.col("high").alias("__high"), F.col("low").alias("__low"), F.col("node"))
    grouped = known.join(roots, F.col("node") == F.col("__node"), "left").select(
        "__high", "__low", F.coalesce("root", "node").alias("group"))
    named = rows.join(grouped, (F.col("high") == F.col("__high")) & (F.col("low") == F.col("__low")))
    return named.select("doc_id", "mark", "row", "group")


def take_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``chosen``, a table of ``row, mark, n`` (``n`` repeats of the row are there) and
    further columns, which are added. Only rows that do repeat are grouped."""
    added = [c for c in chosen.columns if c not in ("row", "mark", "n")]
    keyed = docs.withColumns({"__row": row_hash(docs), "__mark": F.xxhash64("text")})

    def met(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col("row").alias("__r"), F.col("mark").alias("__m"), *added)
        return keyed.join(named, (F.col("__row") == F.col("__r")) & (F.col("__mark") == F.col("__m")))

    once = met(chosen.filter("n = 1")).select(*docs.columns, *added)
    repeated = met(chosen.filter("n > 1")).groupBy("__r", "__m").agg(F.first(F.struct(*docs.columns, *added)).alias("__one"))
    return once.unionByName(repeated.select("__one.*"))
