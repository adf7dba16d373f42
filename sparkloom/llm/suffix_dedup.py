"""Suffix-array dedup: common-prefix-aware distributed merge sort of sparse suffixes.

Suffixes start where a chunk of windows starts (see ``windows``; a unit is a byte) and
reach to the chunk's end.  Suffixes whose minimizer gram occurs once can't repeat and
are left out; the others are sorted:

1. each task sorts its suffixes in lots, settles equal ones, cuts the order at the
   splitters and sends every range as one front-coded run;
2. each range is merged by loser trees that never compare a known prefix again (see
   ``runs``);
3. neighbours in the merged order that share their whole length are repeats.

Suffixes that share a gram but differ as a whole lie at the edges of repeated passages.
Their windows may repeat one by one: neighbours of eight have a core in common, and
where a core occurs in two different suffixes, a second sort of the same kind compares
the eight: as one string if all groups with that core are alike (by two hashes of their
at most ``window`` + 7 bytes), else a suffix of the window's length for each.  A string
that a third of all documents hold is one suffix per lot in the exchange.

Splitters are whole suffixes from a sample of documents; they only balance the work.
There are as many ranges as hold ``RANGE`` bytes each, or as shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from .common import discard, numbered, shuffle_cleanup, stored
from .runs import BLOCK, NUMBERS, Items, decode, front_code, gather, merge, pad, repeats, settle, unite, words_for
from .substring_dedup import _texts
from .windows import Rolling, byte_chunks, cover, flushes, span_arrays

#: Bytes of suffixes in a lot, suffixes that are cut out of texts at a time, bytes of suffixes in a range.
LOT, SLICE, RANGE = 32 << 20, 1 << 16, 16 << 20
#: Keys per range, and in all, in the sample of splitters.
SAMPLE, MOST = 64, 1 << 20
#: Places in a packed row of candidates.
PLACES = 1 << 12

#: Windows that share a core.
CORE = 8

_BLOBS = ["lcp", "rest", "rests", *(n for n, _ in NUMBERS)]
RUNS = "part int, " + ", ".join(f"{b} binary" for b in _BLOBS)
FOUND = "uid long, s int, r int, h long, a int, repeat boolean, cores array<struct<c:long,f:long,g:long>>"


def _flat(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a list of structs: the row of each struct, and its fields."""
    at = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(int(at[0]), int(at[-1] - at[0]))
    return np.repeat(np.arange(len(at) - 1), np.diff(at)), [values.field(c).to_numpy(zero_copy_only=False) for c in fields]


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins."""
    _, offsets, data = text.buffers()
    wide = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    at = np.frombuffer(offsets, wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def candidates(corpus: DataFrame, window: int, gram: int) -> DataFrame:
    """uid, spans (array of s, r, a, h): the chunks whose minimizer gram occurs more than once.

    A lot that has a gram twice knows that all its places are candidates, and keeps them;
    to the exchange by gram it sends one marker, so no gram has more than a row per lot.
    """

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, k in enumerate(flushes(byte_chunks(_texts(batches), window, gram))):
            k = k.take(np.argsort(k.h, kind="stable"))
            new = np.concatenate([[True], k.h[1:] != k.h[:-1]])
            at = np.flatnonzero(new)
            twice = np.diff(np.concatenate([at, [len(k)]])) > 1
            own = k.take(at)
            numbers = [pa.array(c[at].astype(t)) for c, t in ((k.uid, np.int64), (k.s, np.int32), (k.r, np.int32), (k.a, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(own.h.view(np.int64)), *numbers, pa.array(twice), pa.nulls(len(at), pa.binary())], ["h", "uid", "s", "r", "a", "twice", "places"])
            known = k.take(np.flatnonzero(twice[np.cumsum(new) - 1]))
            known = known.take(np.lexsort((known.s, known.uid)))
            rows = np.stack([known.uid, known.s, known.r, known.a, known.h.view(np.int64)], axis=1).astype(np.int64)
            blobs = [rows[i : i + PLACES].tobytes() for i in range(0, len(rows), PLACES)]
            # packed places take no part in the count; their hash only spreads them
            spread = np.random.default_rng([n, len(k), int(k.h[0] & np.uint64(0xFFFFFFFF))]).integers(-(1 << 63), (1 << 63) - 1, len(blobs))
            none = pa.nulls(len(blobs), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(len(blobs), pa.int64()), none, none, none, pa.array(np.zeros(len(blobs), bool)), pa.array(blobs, pa.binary())], ["h", "uid", "s", "r", "a", "twice", "places"])

    place = pa.struct([("s", pa.int32()), ("r", pa.int32()), ("a", pa.int32()), ("h", pa.int64())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            packed = x.column("places")
            single = np.flatnonzero(~packed.is_valid().to_numpy(zero_copy_only=False))
            parts = [np.stack([x.column(c).take(pa.array(single)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("uid", "s", "r", "a", "h")], axis=1)]
            parts += [np.frombuffer(b.as_buffer(), np.int64).reshape(-1, 5) for b in packed.drop_null()]
            a = np.concatenate(parts)
            a = a[np.argsort(a[:, 0], kind="stable")]
            head = np.flatnonzero(np.concatenate([[True], a[1:, 0] != a[:-1, 0]])) if len(a) else np.zeros(0, np.int64)
            values = pa.StructArray.from_arrays([*(pa.array(a[:, c].astype(np.int32)) for c in (1, 2, 3)), pa.array(a[:, 4])], fields=list(place))
            yield pa.RecordBatch.from_arrays([pa.array(a[head, 0]), pa.ListArray.from_arrays(pa.array(np.append(head, len(a)).astype(np.int32)), values)], ["uid", "spans"])

    rows = corpus.select("uid", "text").mapInArrow(lots, "h long, uid long, s int, r int, a int, twice boolean, places binary")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(SqlWindow.partitionBy("h"))).filter("places IS NOT NULL OR (n > 1 AND NOT twice)")
    rows = rows.select("h", "uid", "s", "r", "a", "places").mapInArrow(listed, "uid long, spans array<struct<s:int,r:int,a:int,h:long>>")
    return rows.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _suffixes(batches: Iterator[pa.RecordBatch], window: int, words: int, each: bool) -> Iterator[Items]:
    """Suffixes of rows (uid, text, spans) in slices: of whole chunks, or (``each``) of all windows where a is 0."""
    for x in batches:
        data, begin = _buffer(_one(x.column("text")))
        padded = pad(data, words)
        uid = x.column("uid").to_numpy(zero_copy_only=False)
        doc, (s, r, a, h) = _flat(_one(x.column("spans")), ("s", "r", "a", "h"))
        many = np.where(a == 0, r, 1) if each else np.ones(len(r), np.int64)
        load = np.cumsum(many) // SLICE
        for part in np.split(np.arange(len(s)), np.flatnonzero(np.diff(load)) + 1):
            if not len(part):
                continue
            n = many[part]
            at = np.repeat(part, n)
            step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            numbers = [uid[doc[at]], (s[at] + step).astype(np.int32), np.where(many[at] > 1, 1, r[at]).astype(np.int32), h[at], a[at]]
            size = numbers[2].astype(np.int64) + window - 1
            yield Items(gather(padded, begin[doc[at]] + numbers[1], size, words), size, numbers)


def splitters(docs: DataFrame, spans: DataFrame, window: int, words: int, each: bool) -> list[bytes]:
    """Bounds of ranges of suffixes, from the suffixes of a sample of documents."""
    load = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (F.when(x["a"] == 0, x["r"]).otherwise(1) if each else 1))
    total = spans.agg(F.sum(load)).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * 8 * words // RANGE))
    step = 256  # one key in so many, from so many times more documents
    share = min(1.0, step * min(MOST, SAMPLE * parts) / max(1, total))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _suffixes(batches, window, words, each):
            rows = x.take(np.arange(len(x) // step % step, len(x), step)).bytes()
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in rows], pa.binary())], ["key"])

    sample = F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    rows = docs.select("uid", "text").filter(sample).join(spans.filter(sample).hint("merge"), "uid").mapInArrow(keys, "key binary")
    found = sorted({bytes(r.key) for r in rows.collect()})  # MOST at most, as bounded as a range sort's own sample
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def suffix_runs(corpus: DataFrame, spans: DataFrame, window: int, words: int, each: bool) -> DataFrame:
    """Front-coded sorted runs of suffixes; part -1: the places that a lot has settled, without their suffixes."""
    kind = f"S{8 * words}"
    bounds = np.array(splitters(corpus, spans, window, words, each), kind)
    types = [pa.int32(), *[pa.binary()] * len(_BLOBS)]

    def row(part: int, blobs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([part, *(b if isinstance(b, bytes) else b.tobytes() for b in blobs)], types)], ["part", *_BLOBS])

    def lot(held: list[Items]) -> Iterator[pa.RecordBatch]:
        items = Items.join(held)
        held.clear()
        distinct, rest = settle(items)
        del items
        uid, s, r = unite(*rest.numbers[:3])
        yield row(-1, [b"", b"", b"", uid, s.astype(np.int32), r.astype(np.int32), b"", b""])
        cuts = [0, *np.searchsorted(distinct.bytes().view(kind).ravel(), bounds, side="right").tolist(), len(distinct)]
        for part, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if x < y:
                run = distinct.take(slice(x, y))
                yield row(part, [*front_code(run), *run.numbers])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Items] = []
        for x in _suffixes(batches, window, words, each):
            held.append(x)
            if sum(map(len, held)) * 8 * words >= LOT:
                yield from lot(held)
        if held:
            yield from lot(held)

    # the documents with candidates grow with the corpus: merged at every size, never broadcast
    return stored(corpus.select("uid", "text").join(spans.hint("merge"), "uid").mapInArrow(sort, RUNS), "suffix-runs")


CORES = pa.struct([("c", pa.int64()), ("f", pa.int64()), ("g", pa.int64())])


def core_hashes(items: Items, window: int) -> pa.Array:
    """Of each suffix and group of ``CORE`` windows with neighbouring distances to the gram, a hash of what all of them hold, and two of the whole group.

    The k-th group has the windows that start CORE k to CORE k + CORE - 1 bytes before the
    gram; equal windows are in equal groups, the first that of the last window.
    """
    _, _, r, _, a = (c.astype(np.int64) for c in items.numbers)
    least = np.maximum(a - r + 1, 0) // CORE
    n = a // CORE - least + 1
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for i in range(0, len(items), BLOCK // 2):  # as many bytes as a buffer of ``windows``
        part = slice(i, i + BLOCK // 2)
        rows = items.take(part).bytes()
        which = np.repeat(np.arange(len(rows)), n[part])
        k = least[part][which] + np.arange(len(which)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        row, gram = which * rows.shape[1], a[part][which]
        first = row + np.maximum(gram - CORE * k - CORE + 1, 0)
        last = row + np.minimum(r[part][which] - 1, gram - CORE * k) + window
        roll, roll2 = (Rolling(rows.ravel(), w) for w in (0, 1))
        begin = row + gram - CORE * k
        for o, x in zip(out, (roll.of(begin, begin + window - CORE + 1), roll.of(first, last), roll2.of(first, last))):
            o.append((x + k.astype(np.uint64)).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.concatenate(o)) for o in out], fields=list(CORES)))


def merge_runs(runs: DataFrame, window: int, words: int, distinct: bool) -> DataFrame:
    """``FOUND``: spans of repeats and, if ``distinct``, all different suffixes with their cores."""
    names, lists = ["uid", "s", "r", "h", "a", "repeat", "cores"], pa.list_(CORES)

    def spans(uid: np.ndarray, s: np.ndarray, r: np.ndarray) -> list[pa.Array]:
        none = pa.nulls(len(uid), pa.int64())
        return [pa.array(uid), pa.array(s.astype(np.int32)), pa.array(r.astype(np.int32)), none, none.cast(pa.int32()), pa.array(np.ones(len(uid), bool)), pa.nulls(len(uid), lists)]

    def merged(table: pa.Table) -> pa.Table:
        held = []
        for i in range(table.num_rows):
            lcp, rest, rests, *numbers = (table.column(b)[i].as_py() for b in _BLOBS)
            lcp = np.frombuffer(lcp, np.int32)
            held.append((decode(lcp, np.frombuffer(rest, np.int32), rests, [np.frombuffer(c, t) for c, (_, t) in zip(numbers, NUMBERS)], words), lcp))
        items, placed, common = merge(held)
        found, repeat = repeats(items, placed, common)
        out = pa.table(spans(*unite(*(c[found[repeat]] for c in items.numbers[:3]))), names)
        if distinct:
            kept = items.take(found[~repeat])
            out = pa.concat_tables([out, pa.table([*map(pa.array, kept.numbers), pa.array(np.zeros(len(kept), bool)), core_hashes(kept, window)], names)])
        return out

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                yield pa.RecordBatch.from_arrays(spans(*(np.frombuffer(x.column(n)[i].as_py(), t) for n, t in NUMBERS[:3])), names)

    local = runs.filter("part < 0").mapInArrow(unpack, FOUND)
    return runs.filter("part >= 0").groupBy("part").applyInArrow(merged, FOUND).unionByName(local)


def edges(whole: DataFrame) -> DataFrame:
    """uid, spans: the groups of windows whose core occurs in two different suffixes with one gram; a is 1 if all groups with that core are alike."""
    distinct = whole.filter("NOT repeat")
    mixed = stored(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "suffix-mixed")
    # the first group is that of the last window
    group = F.floor(F.greatest(F.col("a") - F.col("r") + 1, F.lit(0)) / CORE).cast("int") + F.col("k")
    gram = F.col("s") + F.col("a")
    first = F.greatest(F.col("s"), gram - F.col("k") * CORE - (CORE - 1))
    last = F.least(F.col("s") + F.col("r") - 1, gram - F.col("k") * CORE)
    cores = distinct.join(mixed, "h").select("uid", "s", "r", "a", "h", F.posexplode("cores").alias("k", "core")).withColumn("k", group)
    cores = stored(cores.select("uid", first.alias("s"), (last - first + 1).alias("r"), "h", "core.*"), "suffix-cores")
    kinds = F.struct("f", "g", "r")
    again = cores.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min(kinds).alias("x"), F.max(kinds).alias("y")).filter("n > 1")
    again = stored(again.select("c", F.expr("CAST(x = y AS INT)").alias("a")), "suffix-again")
    discard(mixed)
    spans = cores.join(again, "c").select("uid", "s", "r", "a", "h")
    out = stored(spans.groupBy("uid").agg(F.collect_set(F.struct("s", "r", "a", "h")).alias("spans")), "suffix-edges")
    discard(cores)
    discard(again)
    return out


def remove_repeats(docs: DataFrame, window: int = 100, gram: int = 32) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of ``docs``.

    A byte of the UTF-8 text goes if a string of ``window`` bytes covers it that also
    starts earlier: in a document with a smaller doc_id, or earlier in the same.  n_spans
    counts maximal removed runs.

    NULL texts are empty.  NULL and equal doc_ids: see ``numbered``.  Extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shuffle_cleanup(spark)
    corpus = numbered(docs).select("doc_id", "uid", "text")
    spans = stored(candidates(corpus, window, gram), "suffix-candidates")
    words = words_for(2 * window - gram)  # the longest chunk
    runs = suffix_runs(corpus, spans, window, words, each=False)
    discard(spans)
    whole = stored(merge_runs(runs, window, words, distinct=True), "suffix-order")
    discard(runs)
    near = edges(whole)
    words = words_for(window + CORE - 1)
    runs = suffix_runs(corpus, near, window, words, each=True)
    discard(near)
    single = merge_runs(runs, window, words, distinct=False).select("uid", "s", "r")
    found = whole.filter("repeat").select("uid", "s", "r").unionByName(single).groupBy("uid").agg(F.collect_list(F.struct("s", "r")).alias("spans"))

    def rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            n, gone, runs, kept = [], [], [], []
            for t, own in zip(x.column("text"), span_arrays(x.column("spans"))):
                text = t.as_buffer().to_pybytes()
                out = cover(own, len(text), window)
                n.append(len(text))
                gone.append(int(out.sum()))
                runs.append(int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1)))
                kept.append(np.frombuffer(text, np.uint8)[~out].tobytes() if gone[-1] else text)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), *(pa.array(v, pa.int64()) for v in (n, gone, runs)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = stored(found, "suffix-spans")
    for df in (whole, runs):
        discard(df)
    joined = corpus.join(found.hint("merge"), "uid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(rebuild, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
