"""Files of a run in the shared folder: blocks of states and arcs, a log of changed states, a trace.

Vertices are cut into blocks of ``BLOCK`` consecutive ids, for arcs of as many ids as have
about so many arcs.  States and arcs lie in one folder per block, so a join with a few ids reads the folders of those ids only: the ids
are broadcast, and Spark's dynamic partition pruning drops the other folders.

A step of few messages writes only the states of vertices that it changed or that speak, as one
more part of the log.  A vertex's state is the latest of its versions in the base and the
parts; after ``KEEP`` parts the base is written anew.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Vertices in a block of states, and arcs in a block of arcs on average; more where that would make over ``MOST_BLOCKS``.
BLOCK = 1 << 16
MOST_BLOCKS = 4096
#: Parts of the log until the base is written anew.
KEEP = 16
#: Rows (of some 50 bytes) that may be broadcast.
FEW = 1 << 20
#: Rows that a task should be dealt; beyond, there are more tasks than the session asks for.
ROWS = 1_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; made and set only where one machine runs all."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        base = sc.getCheckpointDir()
    return base


@contextmanager
def dealt(spark: SparkSession, rows: int) -> Iterator[int]:
    """Shuffles inside have partitions of about ROWS rows, and at least as many as the session asks for; more aren't put together again."""
    key, join = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (key, join)}
    parts = max(int(before[key]), -(-rows // ROWS))
    if parts > int(before[key]):
        spark.conf.set(key, str(parts))
        spark.conf.set(join, "false")
    try:
        yield int(spark.conf.get(key))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Folder:
    """A folder of one run, under the checkpoint folder."""

    def __init__(self, spark: SparkSession):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
        self.spark = spark
        self.path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/run-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.delete, self.path)

    def delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def new(self, name: str) -> str:
        self.made += 1
        return f"{self.path}/{name}-{self.made}"

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table of the folder, so that it is computed once."""
        path = self.new(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def block_of(column: Column, n: int, arcs: int = 0) -> Column:
    """Number of the block that an id lies in: of states, or of so many arcs."""
    return F.floor(column / F.lit(max(BLOCK * n // max(n, arcs), -(-n // MOST_BLOCKS), 1))).cast("int")


def in_blocks(df: DataFrame, path: str, n: int, *keys: str, arcs: int = 0) -> DataFrame:
    """``df`` written by the block of its first key, sorted by the keys, and read again (with column block).

    Written by ranges of all keys, so a vertex with many rows is dealt out.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumn("block", block_of(F.col(keys[0]), n, arcs))
    marked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.partitionBy("block").parquet(path)
    schema = marked.schema
    return df.sparkSession.read.schema(schema).parquet(path)


def few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if it is known to have at most FEW rows."""
    return F.broadcast(df) if rows <= FEW else df


class BlockArcs:
    """The arcs in blocks of their sources: the more arcs (``rows``) a vertex has, the fewer vertices, so that a step doesn't read many arcs for one."""

    def __init__(self, folder: Folder, edges: DataFrame, n: int, rows: int = 0):
        self.n, self.rows = n, rows
        self.arcs = in_blocks(edges, folder.new("arcs"), n, "src", "dst", arcs=rows).withColumnRenamed("block", "_block")

    def sent(self, emitting: DataFrame, message: dict, rows: int) -> DataFrame:
        """src, dst and payload of the messages of emitting states, at most ``rows`` of which have arcs."""
        # DPP asks for a filter on the side that prunes; states without arcs send nothing
        speaking = few(emitting.filter("degree > 0").withColumn("_at", block_of(F.col("id"), self.n, self.rows)), rows)
        columns = ["src", "dst", *(c.alias(k) for k, c in message.items())]
        return self.arcs.join(speaking, (F.col("_block") == F.col("_at")) & (F.col("src") == F.col("id"))).select(*columns)


class StateLog:
    """States (id, degree, emits, the program's columns): a base in blocks, and parts of changed ones."""

    def __init__(self, folder: Folder, base: DataFrame, n: int, path: str):
        self.folder, self.n, self.base, self.path = folder, n, base, path
        self.columns = [c for c in base.columns if c != "block"]
        self.parts: list[tuple[DataFrame, str]] = []

    @classmethod
    def write(cls, folder: Folder, states: DataFrame, n: int) -> StateLog:
        path = folder.new("states")
        return cls(folder, in_blocks(states, path, n, "id"), n, path)

    def frontier(self) -> DataFrame:
        """States that speak: those of the last part, or of the base where there is none."""
        return (self.parts[-1][0] if self.parts else self.base.select(*self.columns)).filter("emits")

    def _versions(self) -> DataFrame:
        out = self.base.select("block", *self.columns, F.lit(-1).alias("_version"))
        for k, (part, _) in enumerate(self.parts):
            out = out.unionByName(part.select(block_of(F.col("id"), self.n).alias("block"), *self.columns, F.lit(k).alias("_version")))
        return out

    def _latest(self, versions: DataFrame, *more: Column) -> DataFrame:
        kept = [c for c in self.columns if c != "id"]
        last = versions.groupBy("id").agg(F.max_by(F.struct(*kept), "_version").alias("_s"), *more)
        return last.select("id", "_s.*", *(c for c in last.columns if c not in ("id", "_s")))

    def of(self, inbox: DataFrame, rows: int) -> DataFrame:
        """Latest states of the vertices in ``inbox`` (dst, ...; at most ``rows``), with its columns."""
        others = [c for c in inbox.columns if c != "dst"]
        keyed = few(inbox.filter("dst >= 0").withColumn("_at", block_of(F.col("dst"), self.n)), rows)
        met = self._versions().join(keyed, (F.col("block") == F.col("_at")) & (F.col("id") == F.col("dst")))
        if not self.parts:
            return met.select(*self.columns, *others)
        found = self._latest(met, F.first(F.struct("dst", *others)).alias("_m"))
        return found.select(*self.columns, *(F.col(f"_m.{c}").alias(c) for c in others))

    def states(self) -> DataFrame:
        """The latest state of every vertex."""
        return self._latest(self._versions()).select(*self.columns) if self.parts else self.base.select(*self.columns)

    def append(self, changed: DataFrame) -> None:
        """Write a part of new states; the base is written anew after KEEP parts."""
        path, rows = self.folder.new("part"), changed.select(*self.columns)
        rows.write.parquet(path)
        self.parts.append((self.folder.spark.read.schema(rows.schema).parquet(path), path))
        if len(self.parts) > KEEP:
            self.compact()

    def delete(self) -> None:
        for p in (self.path, *(p for _, p in self.parts)):
            self.folder.delete(p)

    def compact(self) -> None:
        """Write the base anew; the last part stays, for its vertices speak next."""
        path = self.folder.new("states")
        base, old = in_blocks(self.states(), path, self.n, "id"), [self.path, *(p for _, p in self.parts[:-1])]
        self.base, self.path, self.parts = base, path, self.parts[-1:]
        for p in old:
            self.folder.delete(p)


class Trace:
    """An append-only table of steps; its plan is one scan, however many steps there are."""

    def __init__(self, folder: Folder):
        self.folder, self.path, self.schema = folder, folder.new("trace"), None

    def append(self, rows: DataFrame, step: int) -> None:
        rows = rows.drop("step")
        self.schema = rows.schema
        rows.write.parquet(f"{self.path}/step={step}")

    def read(self) -> DataFrame | None:
        if self.schema is None:
            return None
        names = self.schema.names
        return self.folder.spark.read.schema(StructType([*self.schema.fields, StructField("step", IntegerType())])).parquet(self.path).select("step", *names)
