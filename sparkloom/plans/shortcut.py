"""Connected components of undirected graphs by hooking and compressing.

The superstep program needs as many steps as the longest shortest path.  Where only the
labels are asked for, and arcs go both ways, each round here hooks every root to the least
root next to it, compresses the chains by pointer doubling, and contracts the arcs to
roots.  A chain of any length in order takes one round and as many jumps as its
logarithm; arcs that contract to loops or repeat others go, so rounds get cheaper.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.superstep import checkpoint_dir, forget


@dataclass
class Labelling:
    """labels has id and label, the least id of the component; rounds of hooking, and of compressing in all."""

    labels: DataFrame
    rounds: int
    jumps: int


def _kept(df: DataFrame, **counts) -> tuple[DataFrame, dict]:
    """Checkpointed, with counts taken on the way."""
    seen = Observation()
    out = df.observe(seen, *(c.alias(k) for k, c in counts.items())).checkpoint()
    return out, seen.get


def _compressed(hooks: DataFrame) -> tuple[DataFrame, int]:
    """node, root from node, up where up < node: everybody's chain followed to its end."""
    now, rounds = hooks.select("node", F.col("up").alias("root")), 0
    held = None
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new, seen = _kept(now.join(above, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), moved=F.count(F.when(F.col("moved"), 1)))
        if held is not None:
            forget(held)
        now, held, rounds = new.select("node", "root"), new, rounds + 1
        if not seen["moved"]:
            return now, rounds


def undirected_components(graph: Graph) -> Labelling:
    """Labels of a graph whose arcs all go both ways (``Graph.from_edges(..., undirected=True)``)."""
    if not graph.spark.sparkContext.getCheckpointDir():
        graph.spark.sparkContext.setCheckpointDir(checkpoint_dir(graph.spark))
    arcs, seen = _kept(graph.edges.filter("src <> dst").select("src", "dst").distinct(), n=F.count(F.lit(1)))
    labels = graph.vertices().select("id", F.col("id").alias("label"))
    held, rounds, jumps = None, 0, 0
    while seen["n"]:
        # arcs go both ways, so the least neighbour of every root is among its dst; roots below all neighbours stay
        hooks = arcs.groupBy("src").agg(F.min("dst").alias("up")).filter("up < src").withColumnRenamed("src", "node")
        roots, n = _compressed(hooks)
        found = labels.join(roots, F.col("label") == F.col("node"), "left").select("id", F.coalesce("root", "label").alias("label"))
        labels, _ = _kept(found, n=F.count(F.lit(1)))
        short = arcs
        for end in ("src", "dst"):
            short = short.join(roots.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        new, seen = _kept(short.filter("src <> dst").select("src", "dst").distinct(), n=F.count(F.lit(1)))
        for old in (arcs, held):
            if old is not None:
                forget(old)
        arcs, held, rounds, jumps = new, labels, rounds + 1, jumps + n
    return Labelling(labels, rounds, jumps)
