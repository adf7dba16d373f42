"""The bulk-synchronous loop.

One superstep is one plan and one action, and its counts are observed as it is written:

    outbox = emitting states  JOIN arcs ON id = src
    inbox  = outbox GROUP BY dst                         (combines before the shuffle)
    states = states JOIN inbox ON id = dst

There are two ways to run it, with the same rows:

* A step of many messages keeps arcs and states partitioned by vertex, so that only the
  messages are shuffled.  All states go to the checkpoint folder, which keeps their
  partitioning and cuts the lineage; files of a step are deleted once the next is written.
* A step of few messages (at most one in ``SPARSE`` vertices, in a graph of over ``LEAST``
  and for a program that is active only where messages are) follows the messages: it reads
  the arcs and states of the blocks that they touch, and writes the states that it changed
  to a log (``state_log``).  Nothing in it grows with the graph.

Either way an executor's loss costs one step at most, and plans don't grow with the steps.

Arcs of a vertex with more than ``HUB`` of them are dealt out by (src, salt) in as many
parts, and its state meets each part; other arcs stay where their states are.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from .program import RunConfig, Step, VertexProgram
from .state_log import BlockArcs, Folder, StateLog, Trace, checkpoint_dir, dealt  # noqa: F401

#: Arcs of one vertex that may lie in one partition.
HUB = 1_000_000
#: A step with at most one message in so many vertices follows its messages; one that does goes on so up to four times as many.
SPARSE = 8
#: The fixed cost of following messages, in vertices: smaller graphs rewrite their states faster than they open files.
LEAST = 200_000

SUPERSTEPS = "step int, active_vertices long, messages_sent long, state_changed boolean"


@dataclass(frozen=True)
class StepLog:
    step: int
    active_vertices: int
    messages_sent: int
    state_changed: bool


@dataclass
class Run:
    """states has id, degree and the program's columns; trace is None unless asked for."""

    graph: Graph
    program: VertexProgram
    config: RunConfig
    states: DataFrame
    logs: list[StepLog]
    max_reached: bool
    trace: DataFrame | None = None

    @property
    def supersteps(self) -> int:
        return len(self.logs)

    def log_frame(self) -> DataFrame:
        rows = [(x.step, x.active_vertices, x.messages_sent, x.state_changed) for x in self.logs]
        return self.graph.spark.createDataFrame(rows, SUPERSTEPS)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that ``checkpoint`` returned."""
    try:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    except Py4JError:
        return  # no checkpoint of its own
    if file.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Arcs:
    """The arcs of a run, near the states that send along them."""

    def __init__(self, edges: DataFrame, states: DataFrame, parts: int, hubs: bool):
        self.many = None
        if hubs:
            found = states.filter(F.col("degree") > HUB).select(F.col("id").alias("src"), F.ceil(F.col("degree") / HUB).cast("int").alias("salts"))
            others = [c for c in edges.columns if c != "src"]
            salted = edges.join(found, "src").withColumn("salt", F.pmod(F.xxhash64(*others, F.monotonically_increasing_id()), F.col("salts")).cast("int"))
            self.many = salted.repartition(parts, "src", "salt").sortWithinPartitions("src", "salt").persist(StorageLevel.DISK_ONLY)
            edges = edges.join(found, "src", "left_anti")
        # sorted once, as every step's join wants them
        self.few = edges.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)

    def sent(self, emitting: DataFrame, message: dict) -> DataFrame:
        """src, dst and payload of every message of the emitting states."""
        columns = ["src", "dst", *(c.alias(k) for k, c in message.items())]
        out = emitting.join(self.few, F.col("id") == F.col("src")).select(*columns)
        if self.many is None:
            return out
        hub = emitting.filter(F.col("degree") > HUB).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("degree") / HUB).cast("int") - 1)))
        return out.unionByName(hub.join(self.many, (F.col("id") == F.col("src")) & (F.col("_salt") == F.col("salt"))).select(*columns))

    def close(self) -> None:
        for df in (self.few, self.many):
            if df is not None:
                df.unpersist()


def _trace(after: DataFrame, outbox: DataFrame | None, program: VertexProgram, step: Step, number: int) -> DataFrame:
    """step, kind_ord, kind, from_id, to_id, seq, distance, label, rank: updates, then messages.

    ``after`` has the observed column's former value in _old.
    """
    value = {"distance": F.lit(None).cast("long"), "label": F.lit(None).cast("long"), "rank": F.lit(None).cast("double")}
    head = [F.lit(number).alias("step")]

    def tail(values: dict) -> list:
        return [v.alias(k) for k, v in (value | values).items()]

    column, name = program.observed() or (None, None)
    differs = ~F.col("_old").eqNullSafe(F.col(column)) & F.col(column).isNotNull() if column else F.lit(False)
    updates = after.filter(differs).select(
        *head, F.lit(0).alias("kind_ord"), F.lit("update").alias("kind"), F.col("id").alias("from_id"), F.lit(None).cast("long").alias("to_id"), F.lit(0).alias("seq"),
        *tail({name: F.col(column)} if column else {}),
    )
    if outbox is None:
        return updates
    messages = outbox.select("src", "dst", *program.payload, F.lit(0).alias("seq"))
    extra = program.extra_messages(after.filter("emits"), step)
    if extra is not None:
        messages = messages.unionByName(extra)
    sent = messages.select(
        *head, F.lit(1).alias("kind_ord"), F.lit("message").alias("kind"), F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "seq",
        *tail({name: F.col(program.payload[0])} if name else {}),
    )
    return updates.unionByName(sent)


def _along() -> Column:
    """Messages that emitting states send along arcs."""
    return F.coalesce(F.sum(F.when(F.col("emits"), F.col("degree"))), F.lit(0))


class _Dense:
    """All states in one checkpoint, partitioned by id like the arcs."""

    def __init__(self, states: DataFrame, edges: DataFrame, parts: int, most: int):
        self.table, self.arcs, self.held = states, None, None
        self.edges, self.parts, self.most = edges, parts, most

    def states(self) -> DataFrame:
        return self.table

    def outbox(self, message: dict, rows: int) -> DataFrame:
        if self.arcs is None:
            self.arcs = Arcs(self.edges, self.table, self.parts, self.most > HUB)
        return self.arcs.sent(self.table.filter("emits").drop("emits"), message)

    def receive(self, inbox: DataFrame, rows: int, always: bool) -> DataFrame:
        joined = self.table.drop("emits").join(inbox, F.col("id") == F.col("dst"), "left")
        return joined.withColumn("active", F.lit(True) if always else F.col("dst").isNotNull())

    def store(self, after: DataFrame, columns: list[str]) -> DataFrame:
        """Writes the step; returns its rows."""
        new = after.checkpoint()
        self.forget()
        self.table, self.held = new.select(*columns), new
        return new

    def forget(self) -> None:
        if self.held is not None:
            forget(self.held)
            self.held = None


class _Sparse:
    """A log of changed states over blocks."""

    def __init__(self, log: StateLog, arcs: BlockArcs, traced: bool):
        self.log, self.arcs, self.traced = log, arcs, traced

    def states(self) -> DataFrame:
        return self.log.states()

    def outbox(self, message: dict, rows: int) -> DataFrame:
        return self.arcs.sent(self.log.frontier().drop("emits"), message, rows)

    def receive(self, inbox: DataFrame, rows: int, always: bool) -> DataFrame:
        return self.log.of(inbox, rows).drop("emits").withColumn("active", F.lit(True))

    def store(self, after: DataFrame, columns: list[str]) -> DataFrame:
        told = after.filter("changed OR emits")
        if self.traced:
            told = told.checkpoint()
        self.log.append(told)
        return told


def run(graph: Graph, program: VertexProgram, config: RunConfig = RunConfig()) -> Run:
    """Iterate until the cap, until nobody has messages, or until no state changes, checked in this order.

    Tasks are as many as the arcs and vertices ask for, so none grows with the graph.
    """
    graph.check_run_nodes(config.source, config.target)
    folder = Folder(graph.spark)
    # read by the degrees and by what keeps the arcs near the states
    with dealt(graph.spark, graph.arc_count()):
        edges = program.edges(graph)
        if not graph.simple:  # else they are as near as a copy would be
            edges = edges.persist(StorageLevel.MEMORY_AND_DISK)
        rows = edges.count()
    with dealt(graph.spark, max(rows, graph.n)) as parts:
        return _run(graph, program, config, folder, edges, rows, parts)


def _run(graph: Graph, program: VertexProgram, config: RunConfig, folder: Folder, edges: DataFrame, rows: int, parts: int) -> Run:
    spark, n = graph.spark, graph.n
    cap = program.max_steps(n) if config.max_steps is None else config.max_steps
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    step = Step(n, arcs=rows)
    base = spark.range(n).repartition(parts, "id").join(degrees, F.col("id") == F.col("src"), "left")
    base = base.select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    states = base.select("id", "degree", *(c.alias(k) for k, c in program.init(config, step).items()))
    states = states.withColumn("emits", program.bootstrap(config))
    # only the vertices that have messages matter, and no totals over all of them are asked for
    local = n > LEAST and not program.always_active and not program.totals() and not program.first_totals()

    seen = Observation()
    first = program.first_totals()
    states = states.observe(seen, _along().alias("_along"), F.max("degree").alias("_most"), *(c.alias(k) for k, c in first.items()))
    if local:
        log = StateLog.write(folder, states, n)
        states = log.states()
    else:
        states = states.checkpoint()
    step.totals = {k: seen.get[k] for k in first}
    pending, most, logs, max_reached = seen.get["_along"], seen.get["_most"], [], False
    dense = _Dense(states, edges, parts, most)
    if not local:
        dense.held = states
    blocks: BlockArcs | None = None
    columns = states.columns
    trace = Trace(folder)
    now: _Dense | _Sparse = dense

    while True:
        number = len(logs)
        if number >= cap:
            max_reached = True
            break
        if not pending and not program.always_active:
            break
        if local and now is dense and pending * SPARSE <= n:
            blocks = blocks or BlockArcs(folder, edges, n, rows)
            if number:
                log = StateLog.write(folder, dense.states(), n)
                dense.forget()
            now = _Sparse(log, blocks, config.trace)
        elif now is not dense and pending * SPARSE > 4 * n:
            dense.table, now = log.states(), dense
        outbox = now.outbox(program.message(step), pending)
        joined = now.receive(program.gathered(outbox, now.states(), step), pending, program.always_active)
        new = program.update(step)
        after = joined.select("id", "degree", "active", *(F.col(k).alias(f"_{k}") for k in program.state), *(F.when(F.col("active"), c).otherwise(F.col(k)).alias(k) for k, c in new.items()))
        changed = F.lit(False)
        for k in program.state:
            changed = changed | ~F.col(k).eqNullSafe(F.col(f"_{k}"))
        after = after.withColumn("changed", changed).withColumn("emits", program.emits())
        if config.trace and program.observed():
            after = after.withColumn("_old", F.col(f"_{program.observed()[0]}"))
        after = after.drop(*(f"_{k}" for k in program.state))
        counted, totals = Observation(), program.totals()
        after = after.observe(
            counted, _along().alias("_along"), F.count(F.when(F.col("active"), 1)).alias("_active"),
            F.coalesce(F.bool_or("changed"), F.lit(False)).alias("_changed"), *(c.alias(k) for k, c in totals.items()))
        was_log = now is dense and local and (not number or dense.held is None)
        stored = now.store(after, columns)
        if was_log:
            log.delete()
        if not local:
            edges.unpersist()
        found = counted.get
        step = Step(n, {k: found[k] for k in totals}, rows)
        pending = found["_along"]
        logs.append(StepLog(number, found["_active"], program.messages_sent(step, pending), found["_changed"]))
        if config.trace:
            sent = now.outbox(program.message(step), pending) if config.trace_messages else None
            trace.append(_trace(stored, sent, program, step, number), number)
            if now is not dense:
                forget(stored)
        if not found["_changed"]:
            break

    if now is not dense and log.parts:
        log.compact()
    edges.unpersist()
    if dense.arcs is not None:
        dense.arcs.close()
    if now is dense and number and trace.schema is None:
        folder.delete(folder.path)
    return Run(graph, program, config, (log.base.select(*columns) if now is not dense else dense.states()).drop("emits"), logs, max_reached, trace.read())
