"""Jaccard join of word shingles with adaptive multi-match prefixes.

Every document is the set of 64-bit hashes of its distinct shingles; rows with equal sets
form a class, known by a 128-bit digest, and only one row of a class goes on.

Two sets that link share at least t = ceil(threshold * size) members, so in any common
order of members they share l among the first size - t + l of each (the prefix that goes
with l), for every l up to t.  Where two sets chose different l, the smaller one holds.
The order and l are chosen twice:

1. *Everybody, ordered by hash.*  l is a fixed share of the size; a set goes on if at least
   l of its prefix members also lie in the prefix of another class.  This needs no
   frequencies and moves about a quarter of the members, which no others follow.
2. *Those that are left, ordered by frequency among them, rare ones first.*  Members that
   only one set has open the prefix; whoever fills the shortest prefix with them has no
   partner.  The others lengthen theirs by cost: the lists under the prefix are to be
   read, and at most (their total length) / l sets can be met l times and are to be
   verified; l is where the sum is least.

A member's list of up to ``HOT`` sets gives pairs, counted and compared if they share
l members.  Longer lists (large groups of near copies) give none: sets that they connect
are packed in tiles of ``TILE`` and compared tile by tile by matrix products; a pair of
tiles returns a spanning forest of its links.  Of the pairs from short lists each set's
best is compared first, and others only if they still lie in different components.  No
candidate is dropped and no list is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, stored
from .components import connected
from .simhash import _root, _unite

WIDTH = 4  # words of a shingle
PERCENT = 85  # least share of common shingles in all shingles of a pair
SHARE = 16  # the first prefix is longer by one in so many members
VERIFY = 64  # cost of a verification, in list entries read
HOT = 64  # a longer list is compared in tiles
TILE = 256  # sets in a tile
TILE_MEMBERS = 1 << 17  # members in a tile, unless it holds a single set
SLICE = 4096  # members multiplied at a time

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles; with fewer words one for all words; empty without words."""
    w = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(width, len(w))
    n = len(w) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out += h[i : i + n] * _ODD[i]
    return np.unique(out)


def need(n: int, percent: int = PERCENT) -> int:
    """Members that a set of n shares with any that it links to."""
    return -(-percent * n // 100)


def _list(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _rows(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """The arrays of longs of a list column, as unsigned numbers."""
    x = batch.column(column)
    flat, ends = x.values.to_numpy(zero_copy_only=False).view(np.uint64), x.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _marks(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_buffer().to_pybytes(), width) for t in batch.column("text")]
        sizes = [len(s) for s in sets]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        halves = np.frombuffer(b"".join(keys), np.int64)[::2]
        first = [s[: n - need(n, percent) + 1 + n // SHARE] for s, n in zip(sets, sizes)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(halves), _list(first)], ["doc_id", "uid", "n", "key", "half", "first"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_buffer().to_pybytes(), width) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([len(s) for s in sets], pa.int64()), _list(sets)], ["uid", "n", "members"])


def chosen(n: int, counts: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """(l, entries) for a set of n whose members in several sets occur in ``counts`` sets, ascending; (0, 0) without partners."""
    t = need(n, percent)
    short = n - t + 1 - (n - len(counts))  # entries that l = 1 needs besides members of one set only
    if short <= 0:
        return 0, 0
    l = np.arange(1, min(t, len(counts) - short + 1) + 1)
    read = np.cumsum(counts)[short - 1 + l - 1]
    best = int(np.argmin(read * (1 + VERIFY / l)))
    return int(l[best]), short + best


def _entries(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, counts, members = batch.column("n").to_numpy(), _rows(batch, "counts"), _rows(batch, "members")
        heads, choice = [np.zeros(0, np.uint64)], np.zeros((len(sizes), 2), np.int64)
        for i, (n, c, h) in enumerate(zip(sizes.tolist(), counts, members)):
            order = np.lexsort((h, c))
            choice[i] = chosen(n, c[order].astype(np.int64), percent)
            heads.append(h[order[: choice[i, 1]]])
        uid, n, l = (np.repeat(x, choice[:, 1]) for x in (batch.column("uid").to_numpy(), sizes, choice[:, 0]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(uid), pa.array(n), pa.array(l)], ["h", "uid", "n", "l"])


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = _rows(batch, "x"), _rows(batch, "y")
        common = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)], np.int64)
        sizes = [np.array([len(s) for s in side], np.int64) for side in (x, y)]
        keep = pa.array(linked(common, *sizes, percent) if len(x) else np.zeros(0, bool))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link."""
    both = pairs.select("a", "b")
    for c, m in (("a", "x"), ("b", "y")):
        both = both.join(sets.select(F.col("uid").alias(c), F.col("members").alias(m)), c)
    return both.select("a", "b", "x", "y").mapInArrow(lambda it: _verified(it, percent), "a long, b long")


def _local(sets: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of members that lie in ``shared``."""
    row, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    at = np.searchsorted(shared, flat)
    at[at == len(shared)] = 0
    hit = shared[at] == flat
    return row[hit], at[hit]


def common_members(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of a shares with each of b, by products of 0/1 matrices, a slice of members at a time."""
    out = np.zeros((len(a), len(b)), np.int64)
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    if not len(shared):
        return out
    (ra, ca), (rb, cb) = _local(a, shared), _local(b, shared)
    for k in range(0, len(shared), SLICE):
        m = []
        for r, c, rows in ((ra, ca, len(a)), (rb, cb, len(b))):
            x = np.zeros((rows, min(SLICE, len(shared) - k)), np.float32)
            inside = (c >= k) & (c < k + SLICE)
            x[r[inside], c[inside] - k] = 1
            m.append(x)
        out += (m[0] @ m[1].T).astype(np.int64)  # counts up to 4096 are exact in a float
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, n) into tiles of one cluster."""
    first, made = TaskContext.get().partitionId() << 32, 0
    group, uids, sets, held = None, [], [], 0

    def tile() -> pa.RecordBatch:
        sizes = [len(s) for s in sets]
        return pa.RecordBatch.from_arrays(
            [pa.array([group]), pa.array([first + made]), pa.array([min(sizes)]), pa.array([max(sizes)]), pa.array([uids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([np.concatenate(sets).tobytes()], pa.binary())],
            ["cluster", "tile", "low", "high", "uids", "sizes", "members"],
        )

    for batch in batches:
        for c, u, s in zip(batch.column("cluster").to_pylist(), batch.column("uid").to_pylist(), _rows(batch, "members")):
            if sets and (c != group or len(sets) == TILE or held + len(s) > TILE_MEMBERS):
                yield tile()
                made, uids, sets, held = made + 1, [], [], 0
            group = c
            uids.append(u)
            sets.append(s.copy())
            held += len(s)
    if sets:
        yield tile()


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between two tiles, or within one."""
    for batch in batches:
        for row in batch.to_pylist():
            same = row["tile_a"] == row["tile_b"]
            side = {}
            for k in "a" if same else "ab":
                sizes = np.array(row[f"sizes_{k}"], np.int64)
                side[k] = sizes, np.split(np.frombuffer(row[f"members_{k}"], np.uint64), np.cumsum(sizes)[:-1])
            (na, a), (nb, b) = side["a"], side["a" if same else "b"]
            p, q = np.nonzero(linked(common_members(a, b), na[:, None], nb[None, :], percent))
            ids = np.array(row["uids_a"] + ([] if same else row["uids_b"]), np.int64)
            parent = np.arange(len(ids))
            _unite(parent, p, q if same else q + len(na))
            root = _root(parent, np.arange(len(ids)))
            child = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root[child]])], ["a", "b"])


def _tiled(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links whose components are those of all links within clusters; ``hot`` has uid, cluster."""
    placed = hot.join(sets, "uid").select("cluster", "n", "uid", "members")
    parts = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "cluster", "n", "uid").sortWithinPartitions("cluster", "n", "uid")
    tiles = stored(ordered.mapInArrow(_packed, "cluster long, tile long, low long, high long, uids array<long>, sizes array<long>, members binary"), "ngram-tiles")
    boxes = tiles.select("cluster", "tile", "low", "high")
    a, b = (boxes.select("cluster", *(F.col(c).alias(f"{c}_{s}") for c in ("tile", "low", "high"))) for s in "ab")
    near = (F.col("tile_a") <= F.col("tile_b")) & (F.lit(100) * F.col("high_a") >= F.lit(percent) * F.col("low_b")) & (F.lit(100) * F.col("high_b") >= F.lit(percent) * F.col("low_a"))
    todo = stored(a.join(b, "cluster").filter(near).select("tile_a", "tile_b"), "ngram-tile-pairs")
    for s in "ab":
        # a tile that meets itself is sent once
        full = tiles.select(F.col("tile").alias(f"tile_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("uids", "sizes", "members")))
        todo = todo.join(full, f"tile_{s}")
    return todo.repartition(parts, "tile_a", "tile_b").mapInArrow(lambda it: _compared(it, percent), "a long, b long")


def _marked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    schema = "doc_id long, uid long, n long, key binary, half long, first array<long>"
    return stored(docs.mapInArrow(lambda it: _marks(it, width, percent), schema), "ngram-marks")


def _survivors(marks: DataFrame, percent: int) -> DataFrame:
    """uid of one row of each class whose first prefix meets enough others."""
    entries = marks.select("uid", "n", "half", F.explode("first").alias("h"))
    shared = entries.groupBy("h").agg(F.min("half").alias("p"), F.max("half").alias("q")).filter("p <> q").select("h")
    partner = F.floor((F.lit(percent) * F.col("n") + 99) / 100)  # the least size of a partner, whose l may be the smaller one
    enough = F.col("met") >= 1 + F.floor(partner / SHARE)
    met = entries.join(shared, "h").groupBy("uid", "n").agg(F.count(F.lit(1)).alias("met")).filter(enough).select("uid")
    return stored(marks.select("uid", "key").join(met, "uid").groupBy("key").agg(F.min("uid").alias("uid")).select("uid"), "ngram-survivors")


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links of ``sets`` (uid, n, members; no two alike) whose components are those of all links."""
    member = sets.select("uid", "n", F.explode("members").alias("h"))
    counts = member.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    known = member.join(counts, "h").groupBy("uid", "n").agg(F.collect_list(F.struct("c", "h")).alias("m"))
    known = known.select("uid", "n", F.col("m.c").alias("counts"), F.col("m.h").alias("members"))
    entries = stored(known.mapInArrow(lambda it: _entries(it, percent), "h long, uid long, n long, l long"), "ngram-entries")
    lists = stored(entries.groupBy("h").agg(F.count(F.lit(1)).alias("length"), F.min("uid").alias("leader")).filter("length > 1"), "ngram-lists")

    hot = entries.join(lists.filter(F.col("length") > HOT), "h").select("uid", "leader").distinct()
    clusters = stored(connected(hot, "uid", "leader").select(F.col("node").alias("uid"), F.col("root").alias("cluster")), "ngram-clusters")
    found = stored(_tiled(clusters, sets, percent), "ngram-tile-links")

    short = entries.join(lists.filter(F.col("length") <= HOT).select("h"), "h")
    a, b = (short.select("h", *(F.col(c).alias(s + c) for c in ("uid", "n", "l"))) for s in "xy")
    sized = (F.col("xuid") < F.col("yuid")) & (F.lit(100) * F.least("xn", "yn") >= F.lit(percent) * F.greatest("xn", "yn"))
    pairs = a.join(b, "h").filter(sized).groupBy(F.col("xuid").alias("a"), F.col("yuid").alias("b")).agg(
        F.count(F.lit(1)).alias("met"), F.min(F.least("xl", "yl")).alias("l"), F.min(F.greatest("xn", "yn")).alias("size"))
    pairs = pairs.filter("met >= l")
    for c in "ab":  # sets of one cluster have met already
        pairs = pairs.join(clusters.select(F.col("uid").alias(c), F.col("cluster").alias(f"c{c}")), c, "left")
    pairs = stored(pairs.filter("ca IS NULL OR cb IS NULL OR ca <> cb").select("a", "b", (F.col("met") / F.col("size")).alias("share")), "ngram-pairs")

    ends = pairs.select("a", "b", "share", F.explode(F.array("a", "b")).alias("u"))
    best = stored(ends.groupBy("u").agg(F.max(F.struct("share", "a", "b")).alias("x")).select("x.a", "x.b").distinct(), "ngram-best")
    found = stored(found.unionByName(verified(best, sets, percent)), "ngram-first-links")
    roots = stored(connected(found, "a", "b"), "ngram-first-roots")
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    for c in "ab":
        rest = rest.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    apart = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    return found.unionByName(verified(rest.filter(apart), sets, percent))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) of every row of ``docs`` (doc_id, text).

    Letters A-Z count as a-z; words are split at ASCII white space.  NULL and empty texts
    have no shingles and link with nothing, not even each other: their component_id is their
    doc_id.  Of rows that share a doc_id each has its own text; rows alike in both are one
    document, reported once per row.  NULL ids don't count for component_id, which is NULL
    if a component has no other.  Extra columns are ignored; an empty table gives an empty
    result.  Shingles are compared by 64-bit hashes, classes of equal sets by 128 bits.
    """
    rows = numbered(docs)
    marks = _marked(rows, width, percent)
    alive = _survivors(marks, percent)
    texts = rows.join(alive, "uid", "left_semi").select("uid", "text")
    sets = stored(texts.mapInArrow(lambda it: _sets(it, width), "uid long, n long, members array<long>"), "ngram-sets")
    if sets.count() > alive.count():  # repeated rows
        sets = stored(sets.dropDuplicates(["uid"]), "ngram-sets")
    roots = stored(connected(links(sets, percent), "a", "b").select(F.col("node").alias("uid"), "root"), "ngram-roots")
    named = marks.select("uid", "key").join(roots, "uid").select("key", "root").distinct()
    classes = marks.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least")).join(named, "key", "left")
    whole = classes.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("lowest"))
    placed = stored(classes.join(whole, "root", "left").select("key", F.coalesce("lowest", "least").alias("component_id")), "ngram-components")
    discard(sets)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return marks.select("doc_id", "n", "key").join(placed, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
