"""Size-tiered compaction of immutable shards under a versioned manifest.

Layout below ``root``::

    data/<run>/part-*.parquet      immutable; a run is what one job wrote
    manifest/v00000001.json        the shards of a version, one JSON object a line, the first with its columns

Arrivals are appended as small shards (``arrival_rows`` at most), as they come.  Shards of one size tier
(powers of ``fanout`` above ``least_bytes``) are merged once there are ``fanout`` of
them, into files of about ``target_bytes``; larger shards are left alone, so a row is
rewritten at most once per tier.  A version exists from the moment its manifest file
is put in place under a name that must be free (see ``create_once``): of two writers one
commits a version, and the other looks at the new state and tries again.  Readers see the
shards of one version.  Replaced files stay for ``retain_seconds``, so a reader that has
begun with an older version can end.  A lost executor only costs its tasks: files become
part of a version after the whole job has committed.

A manifest names all shards, some 200 bytes each, and is read by the driver: at 64 MB a
shard that is 300 MB of manifest for 100 TB.  Larger targets make it smaller.

Merging moves no row between machines: each output file is written by one task that
reads neighbouring input files (``coalesce`` joins scan partitions).
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import create_once, hadoop_fs, read_text, versions

MB = 1 << 20


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    tier: int
    since: int  # the version that brought it
    #: Of the first shard of a version: the version's columns, as JSON.
    schema: dict | None = field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class Policy:
    target_bytes: int = 64 * MB
    least_bytes: int = MB
    fanout: int = 4
    arrival_rows: int = 4096  # of a shard as it arrives
    retain_seconds: float = 3600.0

    def tier(self, size: int) -> int:
        return 0 if size < self.least_bytes else 1 + int(math.log(size / self.least_bytes, self.fanout))

    def done(self, size: int) -> bool:
        """Large enough: two of this size would exceed a target-sized file."""
        return 2 * size > self.target_bytes


class Conflict(RuntimeError):
    """Another writer has committed this version."""


#: Types that a column may be widened to when an arrival has a wider one, or that swallow an arrival's.
WIDER = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 10, "double": 11}


def widened(old: StructType | None, new: StructType) -> StructType:
    """The columns of both, in order of their first appearance, each with the wider of its types.

    Names differ if they do but for case.  Raises ValueError where no type holds both.
    """
    fields = {f.name.lower(): f for f in (old.fields if old else [])}
    for f in new.fields:
        known = fields.get(f.name.lower())
        a, b = (x.dataType.simpleString() if x else "" for x in (known, f))
        if known and a != b and (a not in WIDER or b not in WIDER or WIDER[a] // 10 != WIDER[b] // 10):
            raise ValueError(f"column {f.name} is {a} in the store and {b} in the arrival")
        wide = known and (a == b or WIDER[a] > WIDER[b])
        fields[f.name.lower()] = StructField(known.name if known else f.name, known.dataType if wide else f.dataType, True)
    return StructType(list(fields.values()))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, policy: Policy = Policy()):
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy

    # -- manifest ---------------------------------------------------------------

    def version(self) -> int:
        """0 before the first commit."""
        known = versions(self.spark, f"{self.root}/manifest")
        return known[-1] if known else 0

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version (the newest by default), in manifest order."""
        version = self.version() if version is None else version
        if not version:
            return []
        lines = read_text(self.spark, self._manifest(version)).splitlines()
        return [Shard(**{k: v for k, v in json.loads(x).items() if k != "no"}) for x in lines if x]

    def schema(self, version: int | None = None) -> StructType | None:
        """Columns of all shards of a version, each with the widest type it arrived with; None without shards."""
        version = self.version() if version is None else version
        shards = self.shards(version)
        if not shards:
            return None
        if not shards[0].schema:  # written before manifests had columns
            return self.spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*[s.path for s in shards]).schema
        return StructType.fromJson(shards[0].schema)

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Make ``shards`` version base + 1, or raise Conflict."""
        text = "".join(json.dumps({"no": i} | {k: v for k, v in asdict(s).items() if v is not None}) + "\n" for i, s in enumerate(shards))
        if not create_once(self.spark, self._manifest(base + 1), text):
            raise Conflict(self._manifest(base + 1))
        return base + 1

    def _change(self, gone: set[str], new: list[Shard], schema: StructType | None = None) -> int:
        """Commit the newest version without ``gone`` and with ``new``; tried again while other writers are faster.

        Columns are those of the newest version, widened by ``schema``.  Raises Conflict if
        another writer has replaced a file of ``gone``.
        """
        while True:
            base = self.version()
            now = self.shards(base)
            if not gone <= {s.path for s in now}:
                raise Conflict("another writer has replaced these shards")
            try:
                known = self.schema(base)
                columns = widened(known, schema) if schema else known
                live = [*(s for s in now if s.path not in gone), *new]
                return self.commit(base, [replace(s, schema=None if i or not columns else columns.jsonValue()) for i, s in enumerate(live)])
            except Conflict:
                continue

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}.json"

    # -- data -------------------------------------------------------------------

    def append(self, arrivals: DataFrame) -> int:
        """Write arrivals as they come, without a shuffle, and commit them as new shards.

        Arrivals may have columns that the store hasn't, lack some, or have wider or narrower
        numbers: the store keeps all columns, NULL where a row came without one, in the wider
        type (see ``widened``, whose ValueError is raised before anything is written).
        """
        widened(self.schema(), arrivals.schema)
        return self._change(set(), self._write(arrivals.write.option("maxRecordsPerFile", self.policy.arrival_rows)), arrivals.schema)

    def append_each(self, df: DataFrame, arrivals: int) -> int:
        """Append ``df`` as several arrivals, each of every so-many-th partition of its scan, and compact after each.

        One job writes the files of all; it stands for a stream of deliveries.
        """
        widened(self.schema(), df.schema)
        extra = f"_arrival_{uuid.uuid4().hex}"
        shards = self._write(df.withColumn(extra, F.pmod(F.spark_partition_id(), F.lit(arrivals))).write.partitionBy(extra).option("maxRecordsPerFile", self.policy.arrival_rows))
        shards = shards or self._write(df.limit(0).write)  # an empty file keeps the columns
        groups: dict[str, list[Shard]] = {}
        for s in shards:
            groups.setdefault(s.path.rsplit("/", 2)[-2], []).append(s)
        for name in sorted(groups, key=lambda x: int(x.rsplit("=", 1)[1]) if "=" in x else 0):
            self._change(set(), groups[name], df.schema)
            self._merge()
        self.vacuum()  # only now: files of later arrivals were in no version yet
        return self.version()

    def _write(self, writer: DataFrameWriter) -> list[Shard]:
        """The shards of a new run.  A run that isn't committed is never read; ``vacuum`` deletes it."""
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        writer.option("compression", "zstd").parquet(run)
        fs, p = hadoop_fs(self.spark, run)
        files, found = fs.listFiles(p, True), []
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString().rpartition(run.rpartition("/")[2])[2]
            if f.getPath().getName().startswith("part-"):
                found.append((f"{run}{name}", f.getLen()))
        return [Shard(path, size, self.policy.tier(size), self.version() + 1) for path, size in sorted(found)]

    def plan(self) -> list[Shard]:
        """The shards that the next compaction merges: the lowest tier that is full, else none."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards():
            if not self.policy.done(s.bytes):
                tiers.setdefault(s.tier, []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.policy.fanout), [])

    def compact(self) -> int:
        """Merge until no tier is full, then ``vacuum``; returns the version."""
        self._merge()
        self.vacuum()
        return self.version()

    def _merge(self) -> None:
        while merge := self.plan():
            files = max(1, math.ceil(sum(s.bytes for s in merge) / self.policy.target_bytes))
            if files >= len(merge):
                break  # nothing to gain
            self._change({s.path for s in merge}, self._write(self._load(merge, self.schema()).coalesce(files).write))

    def vacuum(self) -> int:
        """Delete data files older than ``retain_seconds`` that the newest version doesn't name; returns their number.

        So does a run that lost its race or whose job has failed.  Readers of older versions
        and jobs that still write have that long.
        """
        live = {self._key(s.path) for s in self.shards()}
        fs, p = hadoop_fs(self.spark, f"{self.root}/data")
        if not live or not fs.exists(p):
            return 0
        files, old, n = fs.listFiles(p, True), (time.time() - self.policy.retain_seconds) * 1000, 0
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().startswith("part-") and f.getModificationTime() <= old and self._key(f.getPath().toString()) not in live:
                fs.delete(f.getPath(), False)
                n += 1
        return n

    def _key(self, path: str) -> str:
        """A file's path below ``data``, however the store writes the rest."""
        return path.rpartition("/data/")[2]

    def _load(self, shards: list[Shard], schema: StructType) -> DataFrame:
        # files of a delivery lie in folders whose names are no columns of theirs
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with all columns that any of them came with."""
        version = self.version() if version is None else version
        return self._load(self.shards(version), self.schema(version))

    def placement(self) -> DataFrame:
        """Every row's doc_id with the number, tier and bytes of its shard in the newest version."""
        version = self.version()
        listed = self.spark.read.schema("no long, path string, bytes long, tier int").json(self._manifest(version))
        key = lambda path: F.substring_index(path, "/data/", -1)
        listed = listed.select(key(F.col("path")).alias("file"), F.col("no").alias("shard_no"), "tier", F.col("bytes").alias("shard_bytes"))
        df = self.read(version).select("doc_id", key(F.col("_metadata.file_path")).alias("file"))
        # the manifest has a row per shard; Spark broadcasts it below its own limit
        return df.join(listed, "file").select("doc_id", "shard_no", "tier", "shard_bytes", F.lit(version).cast("long").alias("version"))


def shard_table(docs: DataFrame, root: str, policy: Policy = Policy(), arrivals: int = 8) -> ShardStore:
    """Append ``docs`` (any columns, any values) to the store at ``root`` in several arrivals, compacting after each.

    Rows are kept as they are: NULLs, repeated rows and extra columns included.  An empty
    table makes a version with an empty shard.
    """
    store = ShardStore(docs.sparkSession, root, policy)
    store.append_each(docs, arrivals)
    return store
