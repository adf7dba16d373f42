"""Substring dedup over a log-structured index of window fingerprints.

The index holds sorted immutable runs of chunk fingerprints (see ``windows``): gram hash
h, a 128-bit digest c of the chunk's words, and the first place of that chunk.  A run is
bucketed by (h, c) and sorted inside its buckets, so a batch that is dealt out alike
merges with it and no run is shuffled again.  A new batch is

1. fingerprinted where its texts are read; repeats inside one task are settled there,
   so a passage that a third of all documents share is one row per task from then on;
2. sorted by (h, c) into a run, repeats inside the batch settled on the way;
3. merge-joined with the older runs: a chunk that an older run holds is a repeat;
4. verified: a chunk counts as equal only by the digest of all its words, and chunks
   whose gram occurs in chunks of another shape are compared window by window with the
   texts of both sides, by digests of the windows' words; grams that the batch hasn't
   got were compared before and are left alone;
5. committed by a manifest, and runs of similar size are compacted into one.

Removed words never influence what counts as a repeat: windows are judged on the input.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import create_once, delete, discard, numbered, read_text, scratch, shuffle_cleanup, stored, versions
from .windows import Chunks, cover, digests, flushes, span_arrays, word_chunks

RUN = "h long, c binary, uid long, s int, r int"
STORED = RUN + ", seen boolean"  # what a run's files hold: repeats too, until the run is compacted


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for x in batches:
        for uid, text in zip(x.column("uid").to_pylist(), x.column("text")):
            yield uid, text.as_buffer().to_pybytes()


def _rows(k: Chunks, repeat: np.ndarray) -> pa.RecordBatch:
    both = np.stack([k.c, k.d], axis=1)
    digest = pa.Array.from_buffers(pa.binary(16), len(k), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(k.h.view(np.int64)), digest, pa.array(k.uid), pa.array(k.s.astype(np.int32)), pa.array(k.r.astype(np.int32)), pa.array(repeat)],
        ["h", "c", "uid", "s", "r", "repeat"],
    )


def settle(k: Chunks) -> tuple[Chunks, np.ndarray]:
    """Sorted by (h, digest, uid, s), and which chunks repeat an earlier one of the same lot."""
    k = k.take(np.lexsort((k.s, k.uid, k.d, k.c, k.h)))
    same = np.concatenate([[False], (k.h[1:] == k.h[:-1]) & (k.c[1:] == k.c[:-1]) & (k.d[1:] == k.d[:-1])])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
    later = (k.uid > k.uid[first]) | (k.s > k.s[first])
    return k, same & later


class FingerprintIndex:
    """``add`` batches in order of their documents; windows of earlier batches count as earlier.

    ``root`` keeps the index: runs below ``runs/``, and ``manifest/v<n>.json`` with the runs
    of version n.  Another job opens it by the same path and goes on from the newest
    version.  Without ``root`` it lives in the shared folder until the driver ends.
    """

    def __init__(self, spark: SparkSession, window: int = 20, gram: int = 10, fanout: int = 2, root: str | None = None):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.root = (root or scratch(spark, "index")).rstrip("/")
        self.runs: list[dict] = []  # rows, path, buckets
        self.version = 0
        self._tables: dict[str, str] = {}
        shuffle_cleanup(spark)
        # a bucket is one sorted file, so a run needs no sort before it is merged
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        if known := versions(spark, f"{self.root}/manifest"):
            self.version = known[-1]
            saved = json.loads(read_text(spark, self._manifest(self.version)))
            if (saved["window"], saved["gram"]) != (window, gram):
                raise ValueError(f"the index at {self.root} has windows of {saved['window']} words and grams of {saved['gram']}")
            self.runs = saved["runs"]

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}.json"

    def _commit(self, runs: list[dict]) -> None:
        text = json.dumps({"window": self.window, "gram": self.gram, "runs": runs})
        if not create_once(self.spark, self._manifest(self.version + 1), text):
            raise RuntimeError(f"another job has added to the index at {self.root}")
        self.version, self.runs = self.version + 1, runs

    def _buckets(self) -> int:
        """As the first run has; else the session's shuffle partitions."""
        return self.runs[0]["buckets"] if self.runs else int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _fingerprints(self, docs: DataFrame) -> DataFrame:
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lot in flushes(word_chunks(_texts(batches), window, gram)):
                yield _rows(*settle(lot))

        return docs.select("uid", "text").mapInArrow(run, RUN + ", repeat boolean")

    def _write(self, rows: DataFrame, buckets: int) -> dict:
        """``rows`` (``STORED``), dealt out by (h, c) to ``buckets`` tasks, as a run: a sorted file for each bucket."""
        path, name = f"{self.root}/runs/{uuid.uuid4().hex}", f"run_{uuid.uuid4().hex}"
        rows.select("h", "c", "uid", "s", "r", "seen").write.bucketBy(buckets, "h", "c").sortBy("h", "c").option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
        self._tables[path] = name
        return {"rows": self.spark.table(name).filter("NOT seen").count(), "path": path, "buckets": buckets}

    def _run(self, run: dict) -> DataFrame:
        if run["path"] not in self._tables:
            name = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h BIGINT, c BINARY, uid BIGINT, s INT, r INT, seen BOOLEAN) USING parquet CLUSTERED BY (h, c) SORTED BY (h, c) INTO {run['buckets']} BUCKETS LOCATION '{run['path']}'")
            self._tables[run["path"]] = name
        return self.spark.table(self._tables[run["path"]]).filter("NOT seen").drop("seen")

    def close(self) -> None:
        """Forget the runs' table names; the files stay."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()

    def _drop(self, run: dict) -> None:
        if name := self._tables.pop(run["path"], None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, run["path"])

    def history(self) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self._run, self.runs)) if self.runs else self.spark.createDataFrame([], RUN)

    def add(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """uid, s, r of the batch's repeated windows (r windows from word s on).

        ``batch`` and ``corpus`` have uid and text; ``corpus`` holds this and all earlier
        batches, and is read only where verification needs a text.
        """
        marked = stored(self._fingerprints(batch), "fingerprints")
        repeats = [stored(marked.filter("repeat").select("uid", "s", "r"), "repeats")]
        # 2: the run.  Lots have settled their own repeats, so (h, c) has a row per lot at most
        buckets = self._buckets()
        first = F.first(F.struct("uid", "s")).over(Window.partitionBy("h", "c").orderBy("uid", "s"))
        dealt = marked.filter("NOT repeat").drop("repeat").repartition(buckets, "h", "c")
        ranked = dealt.withColumn("seen", F.struct("uid", "s") > first)
        # 3: merge join with the older runs, which are bucketed and sorted by the same keys
        for run in self.runs:
            known = self._run(run).select("h", "c", F.lit(True).alias("known"))
            ranked = ranked.join(known.hint("merge"), ["h", "c"], "left").withColumn("seen", F.col("seen") | F.col("known").isNotNull()).drop("known")
        run = self._write(ranked, buckets)
        discard(marked)
        repeats.append(stored(self.spark.table(self._tables[run["path"]]).filter("seen").select("uid", "s", "r"), "repeats"))
        fresh, old = self._run(run), self.history()
        # 4: grams that occur in chunks of different shape
        both = fresh.select("h", "c", F.lit(True).alias("new")).unionByName(old.select("h", "c", F.lit(False).alias("new")))
        shapes = both.groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.max("new").alias("new"))
        mixed = stored(shapes.filter("a <> b AND new").select("h"), "mixed")  # others were compared with their own batch
        sides = fresh.withColumn("new", F.lit(True)).unionByName(old.withColumn("new", F.lit(False)))
        sides = stored(sides.join(mixed, "h").select("uid", "s", "r", "new"), "sides")
        discard(mixed)
        repeats.append(self._verify(sides, corpus))
        discard(sides)
        # 5: commit, compact
        self._commit([*self.runs, run])
        self._compact()
        return reduce(DataFrame.unionByName, repeats)

    def _verify(self, sides: DataFrame, corpus: DataFrame) -> DataFrame:
        """Compare the windows of ``sides`` (uid, s, r, new) in the texts; uid, s, r = 1 of new repeats."""
        per_doc = sides.groupBy("uid").agg(F.collect_list(F.struct("s", "r", "new")).alias("spans"))
        window = self.window

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                uid, s, new, text = [], [], [], []
                for u, t, spans in zip(x.column("uid").to_pylist(), x.column("text"), x.column("spans").to_pylist()):
                    w = t.as_buffer().to_pybytes().split()
                    stop = np.cumsum([len(v) + 1 for v in w]) - 1
                    start = stop - [len(v) for v in w]
                    at = np.concatenate([np.arange(y["s"], y["s"] + y["r"]) for y in spans])
                    joined = digests(b" ".join(w), start[at], stop[at + window - 1])
                    uid += [u] * len(at)
                    s += at.tolist()
                    new += [y["new"] for y in spans for _ in range(y["r"])]
                    text += [joined[i : i + 16] for i in range(0, len(joined), 16)]
                yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(s, pa.int32()), pa.array(new, pa.bool_()), pa.array(text, pa.binary())], ["uid", "s", "new", "w"])

        # the documents with edges grow with the corpus: merged at every size, never broadcast
        cuts = stored(corpus.select("uid", "text").join(per_doc.hint("merge"), "uid").mapInArrow(cut, "uid long, s int, new boolean, w binary"), "windows")
        least = stored(cuts.groupBy("w").agg(F.min(F.struct("uid", "s")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "least")
        found = stored(cuts.filter("new").join(least, "w").filter(F.struct("uid", "s") > F.col("least")).select("uid", "s", F.lit(1).alias("r")), "repeats")
        discard(cuts)
        discard(least)
        return found

    def _compact(self) -> None:
        """Merge the newest runs while ``fanout`` of them are of similar size (within that factor)."""
        while len(self.runs) >= self.fanout:
            tail = self.runs[-self.fanout :]
            if max(r["rows"] for r in tail) > self.fanout * max(1, min(r["rows"] for r in tail)):
                return
            buckets = tail[0]["buckets"]
            rows = reduce(DataFrame.unionByName, map(self._run, tail))
            self._commit([*self.runs[: -self.fanout], self._write(rows.withColumn("seen", F.lit(False)).repartition(buckets, "h", "c"), buckets)])
            for run in tail:
                self._drop(run)


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 10, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of ``docs``.

    A word goes if a window of ``window`` words covers it whose words also start earlier:
    in a document with a smaller doc_id, or earlier in the same.  The kept words are
    joined by one space.  The documents are added to an index in ``batches`` of ascending
    ids; the result doesn't depend on how many.

    NULL texts have no words.  NULL and equal doc_ids: see ``numbered``.  Extra columns
    are ignored; an empty table gives an empty result.
    """
    corpus = numbered(docs).select("doc_id", "uid", "text")
    spark = docs.sparkSession
    index = FingerprintIndex(spark, window, gram)
    cuts = corpus.select(F.percentile_approx("uid", [i / batches for i in range(1, batches)], 10000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    spans = None
    for low, high in zip(bounds, bounds[1:]):
        batch = corpus if low is None else corpus.filter(F.col("uid") > low)
        batch = batch if high is None else batch.filter(F.col("uid") <= high)
        seen = corpus if high is None else corpus.filter(F.col("uid") <= high)
        found = index.add(batch, seen)
        spans = found if spans is None else spans.unionByName(found)
    index.close()
    delete(spark, index.root)
    per_doc = spans.groupBy("uid").agg(F.collect_set(F.struct("s", "r")).alias("spans"))

    def rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            n, gone, kept = [], [], []
            for t, own in zip(x.column("text"), span_arrays(x.column("spans"))):
                w = t.as_buffer().to_pybytes().split()
                out = cover(own, len(w), window)
                n.append(len(w))
                gone.append(int(out.sum()))
                kept.append(b" ".join(a for a, o in zip(w, out.tolist()) if not o) if gone[-1] else b" ".join(w))
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    joined = corpus.join(stored(per_doc, "repeat-spans").hint("merge"), "uid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(rebuild, "doc_id long, n_words long, n_removed long, kept_text string")
