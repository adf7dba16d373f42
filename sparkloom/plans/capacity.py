"""Widest paths: the greatest weight that can be carried from a source, a program of one's own.

No algorithm of the registry: it shows what a subclass of ``VertexProgram`` needs to say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.program import RunConfig, Step, VertexProgram

#: What the source itself can carry.
WHOLE = (1 << 63) - 1


class WidestPaths(VertexProgram):
    """A path is as wide as its lightest arc; a vertex takes the widest path that reaches it."""

    name, kind = "WidestPaths", "capacities"
    state = ("capacity",)
    payload = ("capacity",)

    def edges(self, graph: Graph) -> DataFrame:
        return graph.edges.select("src", "dst", "weight")

    def init(self, cfg: RunConfig, step: Step) -> dict[str, Column]:
        return {"capacity": F.when(F.col("id") == cfg.source, F.lit(WHOLE)).otherwise(F.lit(0))}

    def bootstrap(self, cfg: RunConfig) -> Column:
        return F.col("id") == cfg.source

    def message(self, step: Step) -> dict[str, Column]:
        return {"capacity": F.least("capacity", "weight")}

    def gather(self, outbox: DataFrame, states: DataFrame) -> DataFrame:
        return outbox.groupBy("dst").agg(F.max("capacity").alias("widest"))

    def update(self, step: Step) -> dict[str, Column]:
        return {"capacity": F.greatest("capacity", "widest")}

    def emits(self) -> Column:
        return F.col("changed")
