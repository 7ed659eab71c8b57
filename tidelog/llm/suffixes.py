"""Repeated substrings by suffix arrays over shards of candidate text.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts elsewhere. Windows of that length are dealt so
that equal ones can meet, without sending every window anywhere:

1. Each window is keyed by the least hash of the ``GRAM``-byte strings in it. Neighbouring windows mostly share it, so
   a text becomes runs of windows, one for about 180 bytes. Equal windows have equal keys.
2. Runs whose key occurs once in the corpus are done: their windows are unique. The others are cut out of their texts
   as regions. Regions that are equal byte for byte become one, with a count; where it is above one, all its windows
   are repeated, whatever the number of copies.
3. Different regions of a key go into shards of bounded size. A shard's suffix array comes from Larsson-Sadakane
   refinement (prefix doubling that sorts only groups not yet single), its common prefixes from Kasai's rule in its
   permuted form: a pair of neighbours that moved on by one together has one byte less in common. Neighbours with
   ``LENGTH`` bytes in common are a class of equal windows.
4. A key with more text than a shard holds is split over several. Each of them sends the sorted digests of its classes,
   cut into ranges, and each range is merged by binary search: a class met in two shards is repeated.

Texts move once by their id, for both cutting and removing; hot keys and hot copies are counted before they move.

Nulls and odd cases: null text is empty; texts shorter than ``LENGTH`` keep all bytes; rows of equal id are told apart
by their text, and equal rows are copies of each other; a null id is an id; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.base import query, stage, table

LENGTH = 400
GRAM = 32
#: Longest run of windows kept in one region, and bytes of regions in a shard.
MAX_RUN = 2048
SHARD_BYTES = 2 << 20
#: Most ranges that the digests of a split key are cut into; there are as many as it has shards.
MAX_RANGES = 1 << 16
_PIECE = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# --- candidate windows -------------------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every ``gram`` bytes (a power of two)."""
    out = (raw.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    size = 1
    while size < gram:
        out = out[:-size] * np.uint64(pow(int(_MULTIPLIER), size, 2**64)) + out[size:]
        size *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, size, least = len(values) - width + 1, 1, values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:n], least[width - size : width - size + n])


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Start, number of windows and key of every run of windows, and whether the string behind the key occurs twice
    nearby: then the text is periodic there, and windows of one run may be equal."""
    raw = np.frombuffer(data, np.uint8)
    starts, counts, keys, twice = [], [], [], []
    width = length - gram + 1
    for at in range(0, max(0, len(raw) - length + 1), _PIECE):
        part = raw[at : at + _PIECE + length - 1]
        hashes = gram_hashes(part, gram)
        least = sliding_min(hashes, width)
        change = least[1:] != least[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(least)]))
        if np.diff(cuts).max() > MAX_RUN:
            cuts = np.unique(np.concatenate([cuts, *(np.arange(a, b, MAX_RUN) for a, b in zip(cuts, cuts[1:]) if b - a > MAX_RUN)]))
        starts.append(cuts[:-1] + at)
        counts.append(np.diff(cuts))
        keys.append(least[cuts[:-1]])
        # A string is the least of some window exactly if it is the greatest of the windows' least around it.
        pad = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
        chosen = np.sort(hashes[hashes == ~sliding_min(np.concatenate((pad, ~least, pad)), width)])
        twice.append(np.isin(keys[-1], chosen[1:][chosen[1:] == chosen[:-1]]))
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys).view(np.int64), np.concatenate(twice)


# --- suffix array, common prefixes -------------------------------------------------------------------------------


def suffix_array(raw: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of at least their first ``depth`` bytes (what lies behind the end counts as zero)."""
    n = len(raw)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = raw
    first = padded[:n].copy()
    for i in range(1, 8):
        first = first << np.uint64(8) | padded[i : n + i]
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = first[order]
    heads = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.flatnonzero(heads)[np.cumsum(heads) - 1]
    rank[order] = group
    ends = np.concatenate((heads[1:], [True]))
    # Places in the order whose group has more than one member.
    open_places = np.flatnonzero(~(heads & ends))
    h = 8
    while h < depth and len(open_places):
        suffix = order[open_places]
        behind = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
        groups = rank[suffix]
        # Groups keep their places, so sorting by group and what follows sorts each group in place.
        by = np.argsort(groups * np.int64(n + 1) + behind, kind="stable")
        suffix, behind, groups = suffix[by], behind[by], groups[by]
        order[open_places] = suffix
        new = np.concatenate(([True], (groups[1:] != groups[:-1]) | (behind[1:] != behind[:-1])))
        rank[suffix] = open_places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        last = np.concatenate((new[1:], [True]))
        open_places = open_places[~(new & last)]
        h *= 2
    return order


def common_prefixes(raw: np.ndarray, order: np.ndarray, enough: int) -> np.ndarray:
    """Bytes that each place of the order has in common with the place before it; exact below ``enough``."""
    n, step = len(raw), 1024
    cap = enough + step + 8
    before = np.empty(n, np.int64)  # by position: the suffix just before it in the order
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    moved = np.zeros(n, bool)
    moved[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    moved[1:] &= raw[: n - 1] == raw[np.maximum(before[:-1], 0)]
    moved[::step] = False
    fresh = np.flatnonzero(~moved & (before >= 0))
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = raw
    words = padded[:n].copy()
    for i in range(1, 8):
        words = words << np.uint64(8) | padded[i : n + i]
    found = np.zeros(n, np.int64)
    mine, other = fresh, before[fresh]
    size = np.zeros(len(fresh), np.int64)
    active = np.arange(len(fresh))
    while len(active):
        a, b = mine[active] + size[active], other[active] + size[active]
        inside = (a < n) & (b < n)
        diff = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        whole = inside & (diff == 0) & (np.maximum(a, b) + 8 <= n)
        part = active[~whole]
        if len(part):
            d, ok = diff[~whole], inside[~whole]
            # Bytes equal from the top; 64-bit floats would round, so halves are compared.
            same = np.zeros(len(part), np.int64)
            same_so_far = np.ones(len(part), bool)
            for i in range(8):
                same_so_far &= (d >> np.uint64(56 - 8 * i) & np.uint64(255)) == 0
                same += same_so_far
            room = n - np.maximum(a, b)[~whole]
            size[part] += np.where(ok, np.minimum(same, room), 0)
        size[active[whole]] += 8
        active = active[whole]
        active = active[size[active] < cap]
    found[fresh] = size
    # Kasai's rule for the others: one less than the position before them.
    lead = np.maximum.accumulate(np.where(moved, 0, np.arange(n)))
    found = np.maximum(0, found[lead] - (np.arange(n) - lead))
    return found[order]


def repeated_windows(regions: list[bytes], counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Class of every window of every region, one after the other: windows are equal exactly if their classes are."""
    raw = np.frombuffer(b"".join(regions), np.uint8)
    sizes = np.array([len(r) for r in regions], np.int64)
    offsets = np.cumsum(sizes) - sizes
    valid = np.repeat(offsets, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    order = suffix_array(raw, length)
    common = common_prefixes(raw, order, length)
    classes = np.cumsum(common < length)
    of = np.empty(len(raw), np.int64)
    of[order] = classes
    return of[valid]


def intervals(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2].tolist(), edges[1::2].tolist()


def _judge_shard(rows: list[tuple[int, bytes, int, int, bytes, int]], length: int) -> Iterator[tuple]:
    """``rows``: key, region id, copies, windows, bytes, shards of the key. Gives, for each region with repeated
    windows, their intervals; for keys of several shards also the sorted digests of all classes, cut into ranges."""
    counts = np.array([r[3] for r in rows], np.int64)
    of = repeated_windows([r[4] for r in rows], counts, length)
    owner = np.repeat(np.arange(len(rows)), counts)
    bounds = np.cumsum(counts) - counts
    place = np.arange(len(of)) - np.repeat(bounds, counts)
    copies = np.array([r[2] for r in rows], np.int64)
    _, dense = np.unique(of, return_inverse=True)
    twice = np.bincount(dense, weights=copies[owner])[dense] >= 2
    for i, (key, rid, n, many, _, _) in enumerate(rows):
        flags = twice[bounds[i] : bounds[i] + many]
        if n == 1 and flags.any():
            yield key, rid, *intervals(flags), None, None, None
    parts = np.array([r[5] for r in rows])
    if parts.max(initial=1) == 1:
        return
    _, firsts = np.unique(dense, return_index=True)
    firsts = firsts[parts[owner[firsts]] > 1]
    keys = np.array([r[0] for r in rows])[owner[firsts]]
    for key in np.unique(keys):
        own = firsts[keys == key]
        texts = (rows[owner[w]][4][place[w] : place[w] + length] for w in own)
        digests = np.frombuffer(b"".join(map(xxhash.xxh128_digest, texts)), "S16")
        by = np.argsort(digests)
        own, digests = own[by], digests[by]
        n_ranges = min(int(parts[owner[own[0]]]), MAX_RANGES)
        ranges = digests.view(np.uint8).reshape(-1, 16)[:, :2].astype(np.int64) @ np.array([256, 1]) * n_ranges >> 16
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        for part in np.split(np.arange(len(own)), cuts):
            # A class that is repeated already needs no answer; the other shards need its digest.
            rids = b"".join(_NO_RID if twice[w] else rows[owner[w]][1] for w in own[part])
            yield int(key), None, place[own[part]].tolist(), None, int(ranges[part[0]]), digests[part].tobytes(), rids


_NO_RID = bytes(16)
_FOUND = "key long, rid binary, begins array<int>, ends array<int>, range int, digests binary, rids binary"
_FOUND_SCHEMA = pa.schema([
    ("key", pa.int64()), ("rid", pa.binary()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
    ("range", pa.int32()), ("digests", pa.binary()), ("rids", pa.binary()),
])


def _found_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 50_000):
        columns = zip(*rows[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA
        )


def shard_results(regions: DataFrame, length: int) -> DataFrame:
    """Judge every shard of ``shard, key, rid, copies, windows, region, parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for at, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != shard and rows:
                    yield from _found_batches(list(_judge_shard(rows, length)))
                    rows = []
                shard = at
                rows.append(tuple(row))
        if rows:
            yield from _found_batches(list(_judge_shard(rows, length)))

    dealt = regions.select("shard", "key", "rid", "copies", "windows", "region", "parts")
    return dealt.repartition("shard").sortWithinPartitions("shard", "key", "rid").mapInArrow(run, _FOUND)


def _merge(key: int, held: list[tuple[list[int], bytes, bytes]]) -> Iterator[tuple]:
    """``held``: offsets, sorted digests and region ids of one range of a key, from each of its shards."""
    sorted_digests = np.sort(np.concatenate([np.frombuffer(d, "S16") for _, d, _ in held]))
    hits: dict[bytes, list[int]] = {}
    for offsets, digests, rids in held:
        mine = np.frombuffer(digests, "S16")
        many = np.searchsorted(sorted_digests, mine, "right") - np.searchsorted(sorted_digests, mine, "left")
        for i in np.flatnonzero(many >= 2):
            rid = rids[16 * i : 16 * i + 16]
            if rid != _NO_RID:
                hits.setdefault(rid, []).append(offsets[i])
    for rid, begins in hits.items():
        yield key, rid, begins, [b + 1 for b in begins], None, None, None


def merge_shards(found: DataFrame) -> DataFrame:
    """Windows whose digest two shards of a key have: sorted digests, merged by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for key, part, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, part) != at and held:
                    yield from _found_batches(list(_merge(at[0], held)))
                    held = []
                at = key, part
                held.append(tuple(row))
        if held:
            yield from _found_batches(list(_merge(at[0], held)))

    ranges = found.filter(F.col("range").isNotNull()).select("key", "range", "begins", "digests", "rids")
    return ranges.repartition("key", "range").sortWithinPartitions("key", "range").mapInArrow(run, _FOUND)


# --- the whole ----------------------------------------------------------------------------------------------------


def _same(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["id"]) & (left["mark"] == right["h"])


def remove_repeats(
    docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every document; ``kept`` are the bytes left."""
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    texts = texts.withColumn("mark", F.xxhash64("data"))

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [runs(t.as_py(), length, gram) for t in batch.column(2)]
            many = np.array([len(o[0]) for o in out], np.int64)
            index = pa.array(np.repeat(np.arange(len(out)), many))
            flat = [np.concatenate([o[i] for o in out]) for i in range(4)] if out else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array(flat[0], pa.int64()),
                 pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.int64()), pa.array(flat[3].astype(bool))],
                names=["doc_id", "mark", "start", "windows", "key", "twice"],
            )

    found = stage(
        texts.select("doc_id", "mark", "data").filter(F.length("data") >= length)
        .mapInArrow(find_runs, f"doc_id {kind}, mark long, start long, windows int, key long, twice boolean")
    )
    again = found.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).filter("n > 1 OR twice").select("key")
    open_runs = found.join(again, "key", "left_semi")
    listed = open_runs.groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("h")).agg(
        F.collect_set(F.struct("start", "windows", "key", "twice")).alias("runs")
    )
    cutting = texts.join(listed, _same(texts, listed))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py()
                own = batch.column(3)[i].as_py()
                pieces = [data[r["start"] : r["start"] + r["windows"] + length - 1] for r in own]
                same = len(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * same)), batch.column(1).take(pa.array([i] * same)),
                     pa.array([r["start"] for r in own], pa.int64()), pa.array([r["windows"] for r in own], pa.int32()),
                     pa.array([r["key"] for r in own], pa.int64()), pa.array([r["twice"] for r in own], pa.bool_()),
                     pa.array([xxhash.xxh128_digest(p) for p in pieces], pa.binary()), pa.array(pieces, pa.binary())],
                    names=["doc_id", "mark", "start", "windows", "key", "twice", "rid", "region"],
                )

    regions = stage(
        cutting.select("doc_id", "mark", "data", "runs")
        .mapInArrow(cut, f"doc_id {kind}, mark long, start long, windows int, key long, twice boolean, rid binary, "
                    "region binary")
    )
    kinds = stage(regions.groupBy("key", "rid").agg(
        F.count("*").alias("copies"), F.max("windows").alias("windows"), F.max(F.length("region")).alias("size"), F.max("twice").alias("twice"),
    ))
    # Only keys with different or periodic regions, one of them single, have anything left to find.
    keys = kinds.groupBy("key").agg(
        F.count("*").alias("n"), F.min("copies").alias("least"), F.sum("size").alias("bytes"),
        F.max("twice").alias("twice"),
    ).filter("least = 1 AND (n > 1 OR twice)")
    keys = stage(keys.select("key", F.ceil(F.col("bytes") / shard_bytes).cast("long").alias("parts"), "bytes"))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    wanted = kinds.join(keys, "key").select(F.col("key").alias("k"), F.col("rid").alias("r"), "copies", "parts")
    distinct = regions.groupBy("key", "rid").agg(F.first("region").alias("region"), F.first("windows").alias("windows"))
    placed = distinct.join(wanted, (F.col("key") == F.col("k")) & (F.col("rid") == F.col("r")))
    salt = F.pmod(F.xxhash64("rid"), F.col("parts"))
    # A split key's parts are shards of their own; the others share shards by a hash of the key.
    shard = F.when(F.col("parts") > 1, F.xxhash64("key", salt)).otherwise(F.pmod(F.xxhash64("key"), F.lit(n_shards)))
    placed = placed.withColumn("shard", shard)
    judged = stage(shard_results(placed, length))
    parts = judged.filter(F.col("range").isNull()).select("key", "rid", "begins", "ends")
    merged = merge_shards(judged).select("key", "rid", "begins", "ends")
    whole = kinds.filter("copies > 1").select(
        "key", "rid", F.array(F.lit(0)).alias("begins"), F.array("windows").alias("ends")
    )
    hits = parts.unionByName(merged).unionByName(whole).select(F.col("key").alias("k"), F.col("rid").alias("r"), "begins", "ends")
    met = regions.select("doc_id", "mark", "start", "key", "rid").join(
        hits, (F.col("key") == F.col("k")) & (F.col("rid") == F.col("r"))
    )
    spans = met.select(
        F.col("doc_id").alias("id"), F.col("mark").alias("h"), "start", F.explode(F.arrays_zip("begins", "ends")).alias("z")
    ).groupBy("id", "h").agg(
        F.collect_set(F.struct((F.col("start") + F.col("z.begins")).alias("s"), (F.col("start") + F.col("z.ends")).alias("e"))).alias("spans")
    )
    final = texts.join(spans, _same(texts, spans), "left").select("doc_id", "data", "spans")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_drop(d.as_py(), s.as_py(), length) for d, s in zip(batch.column(1), batch.column(2), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return final.mapInArrow(
        drop, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _drop(data: bytes, spans: list[dict] | None, length: int) -> tuple[int, int, int, str, bytes]:
    """Remove the bytes of all windows that start in the given spans."""
    merged: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"] + length - 1) for x in spans or ()):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    kept, at = [], 0
    for s, e in merged:
        kept.append(data[at:s])
        at = e
    kept.append(data[at:])
    rest = b"".join(kept)
    return len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left comes last, as text: characters that a removal has cut are replaced in it, not in its digest."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
