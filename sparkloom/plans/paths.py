"""Minimum-hop (BFS) and minimum-weight (Bellman-Ford) paths from one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import MissingSource, MissingTarget, TargetNodeMissing
from ..graph import Graph
from ..operators.program import RunConfig, Step, VertexProgram
from ..operators.superstep import Run, forget

PATH_RESULT = "found boolean, distance long, path array<long>"


def better(candidate: Column, distance: Column) -> Column:
    """Strict improvement; an unreached vertex takes any candidate."""
    return candidate.isNotNull() & (distance.isNull() | (candidate < distance))


class BFS(VertexProgram):
    """Weights are ignored: every arc has length 1."""

    name, kind = "BFS", "path"
    state = ("distance", "predecessor")
    payload = ("distance", "length")

    def edges(self, graph: Graph) -> DataFrame:
        return graph.edges.select("src", "dst", F.lit(1).cast("long").alias("length"))

    def lengths(self, graph: Graph) -> DataFrame:
        """src, dst, length: of parallel arcs one, which is enough for distances."""
        return self.edges(graph).distinct()

    def init(self, cfg: RunConfig, step: Step) -> dict[str, Column]:
        if cfg.source is None:
            raise MissingSource
        return {"distance": F.when(F.col("id") == cfg.source, F.lit(0).cast("long")), "predecessor": F.lit(None).cast("long")}

    def bootstrap(self, cfg: RunConfig) -> Column:
        return F.col("id") == cfg.source

    def message(self, step: Step) -> dict[str, Column]:
        return {"distance": F.col("distance"), "length": F.col("length")}

    def gather(self, outbox: DataFrame, states: DataFrame) -> DataFrame:
        """The least (distance, sender): ties go to the smallest sender."""
        return outbox.groupBy("dst").agg(F.min(F.struct((F.col("distance") + F.col("length")).alias("d"), "src")).alias("best"))

    def update(self, step: Step) -> dict[str, Column]:
        take = better(F.col("best.d"), F.col("distance"))
        return {k: F.when(take, F.col(f"best.{v}")).otherwise(F.col(k)) for k, v in (("distance", "d"), ("predecessor", "src"))}

    def emits(self) -> Column:
        return F.col("changed")

    def observed(self) -> tuple[str, str]:
        return "distance", "distance"


class BellmanFord(BFS):
    """Arc lengths are weights; of parallel arcs the last in list order tells the weight of all."""

    name = "BellmanFord"

    def edges(self, graph: Graph) -> DataFrame:
        return graph.arcs_of_effective_weight().withColumnRenamed("weight", "length")

    def lengths(self, graph: Graph) -> DataFrame:
        return graph.effective_weights().withColumnRenamed("weight", "length")


def distances(run: Run) -> DataFrame:
    """id, distance, predecessor of every vertex."""
    return run.states.select("id", "distance", "predecessor")


def path_to(states: DataFrame, target: int) -> DataFrame:
    """found, distance, path from the source to ``target`` (one row).

    Pointer doubling: tables of every vertex's 2^k-th predecessor, until none is left, then
    the target's chain from the farthest jumps to the nearest; so the joins grow with the
    logarithm of the hops.  Distances rise along a path, which puts it in order.
    """
    spark = states.sparkSession
    end = states.filter(F.col("id") == target).select("distance").first()
    if end is None:
        raise TargetNodeMissing(target)
    if end.distance is None:
        return spark.createDataFrame([(False, None, None)], PATH_RESULT)
    jump = states.filter("predecessor IS NOT NULL").select("id", F.col("predecessor").alias("to"))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        # from 2^k to 2^(k + 1) hops: a jump from where the last one ended
        jump = jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")).checkpoint()
    chain = spark.createDataFrame([(target,)], "id long")
    for jump in reversed(jumps):
        chain = chain.unionByName(chain.join(jump, "id").select(F.col("to").alias("id"))).distinct().checkpoint()
    path = chain.join(states.select("id", "distance"), "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("distance", "id"))), lambda x: x["id"]).alias("path"))
    return path.select(F.lit(True).alias("found"), F.lit(end.distance).cast("long").alias("distance"), "path")


def path_result(run: Run) -> DataFrame:
    if run.config.target is None:
        raise MissingTarget
    if run.config.source is None:
        raise MissingSource
    return path_to(run.states, run.config.target)


def all_paths(states: DataFrame, source: int) -> DataFrame:
    """id, distance, path for every reached vertex.

    Doubling: every vertex holds the last piece of its path and the vertex before it; a round
    puts the piece of that vertex in front, so pieces grow from 2^k to 2^(k + 1) hops and the
    rounds with the logarithm of the hops.
    """
    held = states.filter((F.col("id") == source) | F.col("predecessor").isNotNull()).select(
        "id", "distance", F.array("id").alias("path"), F.when(F.col("id") != source, F.col("predecessor")).alias("before")).checkpoint()
    while True:
        left = Observation()
        front = held.select(F.col("id").alias("before"), F.col("path").alias("front"), F.col("before").alias("_before"))
        longer = held.join(front, "before", "left").select("id", "distance", F.concat(F.coalesce("front", F.array().cast("array<long>")), "path").alias("path"), F.col("_before").alias("before"))
        longer = longer.observe(left, F.count("before").alias("n")).checkpoint()
        forget(held)
        held = longer
        if not left.get["n"]:
            return held.select("id", "distance", "path")
