"""Connected components (least label) and label propagation (most frequent label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.program import RunConfig, Step, VertexProgram
from ..operators.superstep import Run


class LabelProgram(VertexProgram):
    """Labels start as ids and go along arcs; whoever has messages answers, changed or not."""

    kind = "labels"
    state = ("label",)
    payload = ("label",)

    def init(self, cfg: RunConfig, step: Step) -> dict[str, Column]:
        return {"label": F.col("id")}

    def message(self, step: Step) -> dict[str, Column]:
        return {"label": F.col("label")}

    def observed(self) -> tuple[str, str]:
        return "label", "label"


class ConnectedComponents(LabelProgram):
    """A vertex takes the least of its own label and those that reach it."""

    name, kind = "ConnectedComponents", "components"

    def gather(self, outbox: DataFrame, states: DataFrame) -> DataFrame:
        return outbox.groupBy("dst").agg(F.min("label").alias("least"))

    def update(self, step: Step) -> dict[str, Column]:
        return {"label": F.least("label", "least")}


def majority(votes: DataFrame, states: DataFrame, n: int, most: int) -> DataFrame:
    """dst, best (struct c, o): most votes first, then the smallest label (o is its negative); labels are below n, votes ``most`` at most.

    Votes are counted per (vertex, label) before they meet at the vertex, so a vertex with
    many neighbours gathers one row per label and task, not one per neighbour.  Everybody's own
    vote is one more row; a vertex that has no other gets no row.  Count and label fit in one
    number as a rule, so nothing has to be sorted to find the best.
    """
    own = states.select(F.col("id").alias("dst"), "label")
    counts = votes.select("dst", "label").unionByName(own).groupBy("dst", "label").agg(F.count(F.lit(1)).alias("c"))
    bits = n.bit_length()
    packed = bits + (most + 1).bit_length() <= 63
    rank = F.shiftleft("c", bits) + (F.lit((1 << bits) - 1) - F.col("label")) if packed else F.struct("c", (-F.col("label")).alias("o"))
    best = counts.groupBy("dst").agg(F.max(rank).alias("best"), F.sum("c").alias("votes")).filter("votes > 1")
    if not packed:
        return best.select("dst", "best")
    o = F.col("best").bitwiseAND(F.lit((1 << bits) - 1)) - F.lit((1 << bits) - 1)
    return best.select("dst", F.struct(F.shiftright("best", bits).alias("c"), o.alias("o")).alias("best"))


class LabelPropagation(LabelProgram):
    """The own label has one vote, each message one; ties go to the smallest label."""

    name = "LabelPropagation"

    def gathered(self, outbox: DataFrame, states: DataFrame, step: Step) -> DataFrame:
        return majority(outbox, states, step.n, step.arcs)

    def update(self, step: Step) -> dict[str, Column]:
        own = F.struct(F.lit(1).cast("long").alias("c"), (-F.col("label")).alias("o"))
        return {"label": -F.greatest(F.col("best"), own)["o"]}


def components(run: Run) -> DataFrame:
    """label, members (ascending) of each component."""
    return run.states.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("members"))


def component_pages(labelling: DataFrame, size: int = 10_000) -> DataFrame:
    """label, page_no, members (ascending): a component of any size in rows of at most ``size`` members.

    Page k has the members from k * size on, so the pages in order list the component.
    """
    page = F.floor(F.col("id") / size).cast("long").alias("page_no")
    return labelling.groupBy("label", page).agg(F.sort_array(F.collect_list("id")).alias("members"))


def labels(run: Run) -> DataFrame:
    """id, label of every vertex."""
    return run.states.select("id", "label")


def unstable(graph: Graph, labelling: DataFrame) -> DataFrame:
    """id, label, wanted of vertices that would change if all in-neighbours voted once more."""
    lab = labelling.select("id", "label")
    votes = graph.edges.select("src", "dst").join(lab, F.col("id") == F.col("src")).select("dst", "label")
    best = majority(votes, lab, graph.n, graph.arc_count())
    own = F.struct(F.lit(1).cast("long").alias("c"), (-F.col("label")).alias("o"))
    wanted = -F.greatest(F.col("best"), own)["o"]
    return lab.join(best, F.col("id") == F.col("dst")).select("id", "label", wanted.alias("wanted")).filter("label <> wanted")


def is_stable(graph: Graph, labelling: DataFrame) -> bool:
    return unstable(graph, labelling).isEmpty()
