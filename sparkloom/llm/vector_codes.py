"""Product codes of vectors by Yinyang Lloyd, in exact integers.

Components become integers floor(4096 * x), and each vector is cut into parts; every part
position has a codebook of its own.  A round assigns each part to the nearest entry
(squared Euclidean distance, ties to the lower index) and moves each entry to the floored
mean of its parts.

Most distances are never taken (Ding et al., "Yinyang K-Means", 2015): a codebook's entries
are clustered into groups once, and each part keeps one lower bound per group for its
distance to the group's entries other than its own.  After a round the bound shrinks by the
group's largest drift; a group is scanned only if its bound no longer lies above the exact
distance to the own entry.  Bounds are floats rounded down, with a margin far above their
error, and only ever rule groups out: what is scanned is decided by integers, ties too.

Between rounds a row holds its integers, its code and its bounds, in files of the shared
folder, so a lost executor costs a task.  A task also writes the sums of what moved to
or from each entry in it (a bounded table); entries are the exact quotients of their
totals, and these, a few thousand numbers, are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, light, stored

SCALE = 4096
MARGIN = 1e-6  # relative; float errors of a bound are below 1e-12
UNSET = 255
STATE = "vec_id long, label {label}, ints array<int>, code binary, bounds binary, moved array<long>"


@dataclass(frozen=True)
class Spec:
    parts: int = 8
    entries: int = 16
    groups: int = 4
    rounds: int = 6


def cuts(size: int, parts: int) -> list[slice]:
    """Equal consecutive parts; if they can't be equal, the first ones are longer by one."""
    ends = np.cumsum([0] + [size // parts + (i < size % parts) for i in range(parts)])
    return [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def exact_squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to entries; through floats where they hold every integer on the way."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    return out.astype(np.int64)


def grouped(entries: np.ndarray, groups: int, steps: int = 5) -> np.ndarray:
    """Group of each entry, by a few steps of Lloyd among the entries; starts lie evenly between them."""
    groups = max(1, min(groups, len(entries)))
    centres = entries[np.linspace(0, len(entries) - 1, groups).astype(int)].astype(np.float64)
    for _ in range(steps):
        of = ((entries[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (of == g).any():
                centres[g] = entries[of == g].mean(axis=0)
    return of


def down(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats, never above x."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def assign(x: np.ndarray, entries: np.ndarray, of: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, exact squared distance, bounds, distances taken) of rows x of one part.

    ``code`` is the last one (UNSET at first), ``bounds`` (rows x groups, floats) are lower
    bounds under the present entries.
    """
    rows, new = np.arange(len(x)), code.astype(np.int64)
    fresh = code == UNSET
    new[fresh] = 0
    own = x - entries[new]
    least = (own * own).sum(axis=1)
    taken, reach = len(x), np.sqrt(least.astype(np.float64)) * (1 + MARGIN) + MARGIN
    bounds = np.where(fresh[:, None], 0, bounds.astype(np.float64))
    for g in range(bounds.shape[1]):
        members = np.flatnonzero(of == g)
        scan = np.flatnonzero(bounds[:, g] <= reach)
        if not len(scan) or not len(members):
            continue
        d = exact_squares(x[scan], entries[members])
        taken += d.size
        first = d.argmin(axis=1)  # the lower index, as members ascend
        near = d[np.arange(len(scan)), first]
        rest = d.copy()
        rest[np.arange(len(scan)), first] = np.iinfo(np.int64).max
        second = rest.min(axis=1)
        here, best = members[first], scan
        better = (near < least[best]) | ((near == least[best]) & (here < new[best]))
        same = here == new[best]
        # the bound leaves out the assigned entry: the second if that is the nearest of the group, else the nearest
        bounds[best, g] = np.sqrt(np.where(better | same, second, near).astype(np.float64)) * (1 - MARGIN)
        won = best[better]
        # who is left for an entry of this group leaves the old entry to the bound of its own group
        left = of[new[won]]
        away = left != g
        bounds[won[away], left[away]] = np.minimum(bounds[won[away], left[away]], np.sqrt(least[won[away]].astype(np.float64)) * (1 - MARGIN))
        least[won], new[won] = near[better], here[better]
    return new.astype(np.uint8), least, bounds, taken


def _ints(x: Column) -> Column:
    return F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")))


def _finite(x: Column) -> Column:
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))


class Books:
    """Codebooks (list of entries x length arrays), their groups, and each group's largest drift in the last round."""

    def __init__(self, entries: list[np.ndarray], of: list[np.ndarray]):
        self.entries, self.of = entries, of
        self.drift = [np.zeros(o.max(initial=0) + 1) for o in of]

    def moved_to(self, entries: list[np.ndarray]) -> Books:
        out = Books(entries, self.of)
        for p, (a, b, o) in enumerate(zip(self.entries, entries, self.of)):
            far = np.sqrt(((a - b).astype(np.float64) ** 2).sum(axis=1)) * (1 + MARGIN)
            out.drift[p] = np.array([far[o == g].max(initial=0) for g in range(o.max(initial=0) + 1)])
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for row in e.tolist() for v in row).encode()).hexdigest()


def _round(batches: Iterator[pa.RecordBatch], books: Books, where: list[slice], last: bool) -> Iterator[pa.RecordBatch]:
    """Assigns every part; last: with errors, else with the new bounds and, at the end, a row of what moved."""
    parts, k, groups = len(where), len(books.entries[0]), max(o.max(initial=0) + 1 for o in books.of)
    size = where[-1].stop
    sums, counts = np.zeros((k, size), np.int64), np.zeros((k, parts), np.int64)
    schema = None
    for batch in batches:
        schema, n = batch.schema, batch.num_rows
        x = batch.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, size)
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts)
        bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float32).reshape(n, parts, groups)
        new, error, low = np.empty_like(code), np.zeros(n, np.int64), np.zeros((n, parts, groups), np.float32)
        for p, w in enumerate(where):
            own = len(books.drift[p])
            shrunk = bounds[:, p, :own].astype(np.float64) - books.drift[p][None, :]
            new[:, p], least, kept, _ = assign(x[:, w], books.entries[p], books.of[p], code[:, p], shrunk)
            error += least
            if last:
                continue
            low[:, p, :own] = np.maximum(down(kept), 0)
            for r, sign in ((new[:, p], 1), (code[:, p], -1)):
                at = np.flatnonzero((new[:, p] != code[:, p]) & (r != UNSET))
                counts[:, p] += sign * np.bincount(r[at], minlength=k)
                order = at[np.argsort(r[at], kind="stable")]
                if len(order):
                    which, starts = np.unique(r[order], return_index=True)
                    sums[which, w] += sign * np.add.reduceat(x[order, w], starts, axis=0)
        if last:
            text = ["".join(f"{c:02x}" for c in row) for row in new.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])
        else:
            raw = [pa.array([r.tobytes() for r in part], pa.binary()) for part in (new, low)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("ints"), *raw, pa.nulls(n, pa.list_(pa.int64()))], schema.names)
    if schema is not None and not last:
        moved = pa.array([np.concatenate([sums.ravel(), counts.ravel()]).tolist()], pa.list_(pa.int64()))
        none = [pa.nulls(1, schema.field(c).type) for c in schema.names[:-1]]
        yield pa.RecordBatch.from_arrays([*none, moved], schema.names)


def _totals(state: DataFrame) -> dict[int, int]:
    """What moved in a round, by place in the tasks' tables."""
    rows = state.filter("moved IS NOT NULL").select(F.posexplode("moved").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return {r.at: int(r.v) for r in rows.collect()}  # (entries x components) numbers


def _states(vectors: DataFrame, spec: Spec, size: int, groups: int) -> DataFrame:
    code, bounds = bytes([UNSET]) * spec.parts, bytes(4 * spec.parts * groups)
    return vectors.select("vec_id", "label", F.col("ints").cast("array<int>").alias("ints"), F.lit(code).alias("code"), F.lit(bounds).alias("bounds"), F.lit(None).cast("array<long>").alias("moved"))


RESULT = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def encode(vectors: DataFrame, spec: Spec = Spec()) -> tuple[DataFrame, Books | None]:
    """Codes of ``vectors`` (vec_id, embedding, label) and the final codebooks.

    Returns vec_id, code (0-based entries in part order, two hex digits each), error (squared
    distances summed over parts), label_error (error summed over equal labels, NULLs
    together), codebooks_sha256.  Vectors that are NULL or hold NULL or non-finite
    components are dropped, and so are those whose length isn't that of the vector with the
    smallest vec_id (smallest vector, if that id repeats).  Each codebook starts with its part of
    the ``entries`` smallest vec_ids, once for each id, or of as many as there are; rows
    without a vec_id are coded but start none, and if no row has one the result is empty.  Repeated rows count each time.  A length that parts don't
    divide gives the first parts one component more.  Components so large that distances
    would exceed 64 bits (beyond 46,000 at 64 components) are an error.  Extra columns
    are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    label = vectors.schema["label"].dataType.simpleString()
    kept = vectors.filter(_finite(F.col("embedding")) & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", _ints(F.col("embedding")).alias("ints"))
    starts = kept.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id")
    head = starts.limit(1).collect()
    empty = spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if not head:
        return empty, None
    size = len(head[0].ints)
    kept = kept.filter(F.size("ints") == size)
    span = kept.agg(F.min(F.array_min("ints")).alias("low"), F.max(F.array_max("ints")).alias("high")).first()
    if 4 * size * max(-span.low, span.high) ** 2 >= 1 << 63:
        raise ValueError(f"components from {span.low / SCALE:g} to {span.high / SCALE:g} are too large: distances would exceed 64 bits")
    first = np.array([r.ints for r in starts.filter(F.size("ints") == size).limit(spec.entries).collect()], np.int64)
    where = cuts(size, spec.parts)
    entries = [first[:, w].copy() for w in where]
    books = Books(entries, [grouped(e, spec.groups) for e in entries])
    groups, k = max(len(d) for d in books.drift), len(first)
    sums, counts = np.zeros((k, size), object), np.zeros((k, spec.parts), object)
    state, schema = _states(kept, spec, size, groups), STATE.format(label=label)
    held = None
    for _ in range(spec.rounds):
        after = stored(state.mapInArrow(lambda it, b=books: _round(it, b, where, False), schema), "vector-round")
        if held is not None:
            discard(held)
        held, moved = after, _totals(after)
        for at, v in moved.items():
            if at < k * size:
                sums[at // size, at % size] += v
            else:
                counts[(at - k * size) // spec.parts, (at - k * size) % spec.parts] += v
        means = [e.copy() for e in books.entries]
        for p, w in enumerate(where):
            for e in range(k):
                if counts[e, p]:
                    means[p][e] = [s // counts[e, p] for s in sums[e, w]]
        books = books.moved_to(means)
        state = after.filter("moved IS NULL")
    coded = stored(state.mapInArrow(lambda it, b=books: _round(it, b, where, True), f"vec_id long, label {label}, code string, error long"), "vector-codes")
    if held is not None:
        discard(held)
    of_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "vector-labels")
    out = coded.join(light(of_label), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), books


def vector_codes(vectors: DataFrame, spec: Spec = Spec()) -> DataFrame:
    return encode(vectors, spec)[0]
