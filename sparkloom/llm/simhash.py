"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: 64 bits; a bit is set if it is set in over half of the XXH64 values of a
text's word shingles.  Equal fingerprints collapse first (an aggregation that combines
before the shuffle), so groups of exact copies never meet each other.

Distinct fingerprints are ordered by population count, then by those of their eight
bytes, by a range sort, and cut into tiles of ``tile_rows``, however many that makes.  Two
fingerprints differ in at least as many bits as their counts do, and as those of their
bytes do in sum, so a pair of tiles whose boxes of counts lie further apart than the
radius is skipped; inside a tile pair the same holds for blocks of 256.  Remaining
blocks are compared exactly with numpy's xor and bit_count.  A tile is one packed row of
64 KB, which travels once per remaining pair; of each tile the driver holds the box, and
tasks find the pairs.  A pair returns a spanning forest of its links (a
row per fingerprint at most), never all pairs, and the forests are joined by star
contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected

BLOCK = 256
PER_TASK = 64  # tiles that a task sorts and packs
PAIRS = 16  # pairs of tiles that a task compares
STEP = 1 << 16  # shingles hashed at a time


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text; 0 without words."""
    w = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    joined = b" ".join(w)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(w) - width + 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(w)) - 1 :].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, STEP):
        h = np.array([digest(view[a:b], seed) for a, b in zip(starts[k : k + STEP], ends[k : k + STEP])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(fp.view(np.int64))], ["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (md5 of the text), fp (the fingerprint's bits as a signed long) of whole texts."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text"), F.md5(text).alias("digest"))
    return df.mapInArrow(_fingerprints, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, digest string, fp long")


def bit_counts(fp: np.ndarray) -> np.ndarray:
    """n x 9: bits set in all, then in each byte, the highest first."""
    c = np.bitwise_count(fp.view(np.uint64).byteswap().view(np.uint8)).reshape(-1, 8)
    return np.concatenate([c.sum(axis=1, dtype=np.uint8)[:, None], c], axis=1)


def order_key(fp: np.ndarray) -> np.ndarray:
    """Sorts by the counts, then by the fingerprint's upper bits."""
    key = np.zeros(len(fp), np.uint64)
    for c in bit_counts(fp).T:
        key = (key << np.uint64(4)) + c.astype(np.uint64)
    return ((key << np.uint64(24)) | (fp.view(np.uint64) >> np.uint64(40))).view(np.int64)


def _gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Least number of differing bits that the boxes allow: rows of a against rows of b."""
    apart = np.maximum(np.maximum(low_a[:, None, :] - high_b[None, :, :], low_b[None, :, :] - high_a[:, None, :]), 0)
    return np.maximum(apart[:, :, 0], apart[:, :, 1:].sum(axis=2))


def boxes(ordered: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest counts of every ``rows`` fingerprints."""
    c, at = bit_counts(ordered).astype(np.int16), np.arange(0, len(ordered), rows)
    return np.minimum.reduceat(c, at, axis=0), np.maximum.reduceat(c, at, axis=0)


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = parent[up]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = _root(parent, a), _root(parent, b)
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def forest(fp_a: np.ndarray, fp_b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, root) that connect what is within ``radius`` between a and b, or within a."""
    a = fp_a[np.argsort(order_key(fp_a), kind="stable")]
    b = a if fp_b is None else fp_b[np.argsort(order_key(fp_b), kind="stable")]
    both, shift = (a, 0) if fp_b is None else (np.concatenate([a, b]), len(a))
    ua, ub, parent = a.view(np.uint64), b.view(np.uint64), np.arange(len(both))

    if not len(a) or not len(b):
        return both[:0], both[:0]
    (la, ha), (lb, hb) = boxes(a, BLOCK), boxes(b, BLOCK)
    for i in range(len(la)):
        near = np.flatnonzero(_gap(la[i : i + 1], ha[i : i + 1], lb, hb)[0] <= radius)
        for j in near[near >= i] if fp_b is None else near:
            x, y = ua[i * BLOCK : (i + 1) * BLOCK], ub[j * BLOCK : (j + 1) * BLOCK]
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if len(p):
                _unite(parent, p + i * BLOCK, q + j * BLOCK + shift)
    root = _root(parent, np.arange(len(both)))
    child = np.flatnonzero(root != np.arange(len(both)))
    return both[child], both[root[child]]


def links(unique: DataFrame, radius: int = 3, tile_rows: int = 8192) -> DataFrame:
    """a, b: links whose components are those of all pairs of ``unique.fp`` within ``radius``."""
    spark = unique.sparkSession
    tasks = max(1, -(-unique.count() // (PER_TASK * tile_rows)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fp = x.column("fp").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(order_key(fp))], ["fp", "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x.column("fp").to_numpy(zero_copy_only=False) for x in batches]
        fp = np.concatenate(held) if held else np.zeros(0, np.int64)
        fp = fp[np.argsort(order_key(fp), kind="stable")]
        first = TaskContext.get().partitionId() << 32
        for k in range(0, len(fp), tile_rows):
            part = fp[k : k + tile_rows]
            low, high = boxes(part, len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + k // tile_rows]), pa.array([low[0].tolist()], pa.list_(pa.int32())), pa.array([high[0].tolist()], pa.list_(pa.int32())), pa.array([part.tobytes()], pa.binary())],
                ["tile", "low", "high", "fps"],
            )

    ordered = unique.select("fp").mapInArrow(keyed, "fp long, key long").repartitionByRange(tasks, "key").select("fp")
    tiles = stored(ordered.mapInArrow(pack, "tile long, low array<int>, high array<int>, fps binary"), "simhash-tiles")
    found = tiles.select("tile", "low", "high").orderBy("tile").toArrow()  # 80 bytes for each tile_rows fingerprints
    number = found.column("tile").to_numpy()
    low, high = (np.array(found.column(c).combine_chunks().flatten().to_numpy(), np.int16).reshape(-1, 9) for c in ("low", "high"))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in x.column("id").to_pylist():
                j = i + np.flatnonzero(_gap(low[i : i + 1], high[i : i + 1], low[i:], high[i:])[0] <= radius)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), number[i])), pa.array(number[j])], ["i", "j"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i, j, a, b in zip(*(x.column(c).to_pylist() for c in ("i", "j", "a", "b"))):
                child, root = forest(np.frombuffer(a, np.int64), None if i == j else np.frombuffer(b, np.int64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], ["a", "b"])

    slices = max(1, min(len(number), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    todo = stored(spark.range(0, len(number), 1, slices).mapInArrow(paired, "i long, j long"), "simhash-pairs")
    sides = [tiles.select(F.col("tile").alias(t), F.col("fps").alias(c)) for t, c in (("i", "a"), ("j", "b"))]
    n = max(1, -(-todo.count() // PAIRS))
    return todo.join(sides[0], "i").join(sides[1], "j").repartition(n, "i", "j").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, tile_rows: int = 8192) -> DataFrame:
    """doc_id, digest, fp, component_id (smallest doc_id of all that links reach), root of every row of ``docs``.

    digest is the md5 of the text; root names the component by one of its fingerprints.

    NULL and empty texts have fingerprint 0 and link like any other.  Rows with equal ids
    are fingerprinted one by one.  NULL ids don't count for component_id (which is NULL if
    a component has no other).  Extra columns are ignored; an empty table gives an empty
    result.
    """
    marked = stored(fingerprints(docs), "simhash")
    unique = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-unique")
    roots = stored(connected(links(unique, radius, tile_rows), "a", "b").withColumnRenamed("node", "fp"), "simhash-roots")
    placed = unique.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    table = stored(placed.join(least, "root").select("fp", "component_id", "root"), "simhash-components")
    return marked.join(table, "fp").select("doc_id", "digest", "fp", "component_id", "root")


def keep_first(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row, with all columns, of each component: the smallest doc_id, NULL last, then the smallest digest."""
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")
    found = near_duplicates(docs, radius).groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    first = stored(found.groupBy("root").agg(F.min_by(F.struct("doc_id", "digest", "rows"), key).alias("k")).select("k.*"), "simhash-first")
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_digest"))
    kept = packed.join(first, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest")))
    twice = first.filter("rows > 1").limit(1).count()
    return (kept.dropDuplicates(["_id", "_digest"]) if twice else kept).select("_row.*")
