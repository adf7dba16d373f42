"""Vertex programs as column expressions.

A program says how states begin, what an emitting vertex sends along an arc, how the
messages to a vertex are combined, and how its state follows.  Each part is a Column or
a small DataFrame plan, so a superstep is one relational plan that Catalyst sees whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


@dataclass(frozen=True)
class RunConfig:
    source: int | None = None
    target: int | None = None
    max_steps: int | None = None  # the program's own cap by default
    trace: bool = False
    trace_messages: bool = True  # else a trace lists updates only


@dataclass
class Step:
    """What an update may refer to besides columns: n, the totals of the previous step, and the number of arcs."""

    n: int
    totals: dict[str, float | int | None] = field(default_factory=dict)
    arcs: int | None = None


class VertexProgram:
    """Subclass this to define an algorithm.

    States are rows (id, degree, <state columns>).  In ``update`` the inbox columns are
    NULL for vertices without messages, and ``active`` tells who has any.
    """

    name = "program"
    kind = "vertex"
    #: Columns that make up a state: a step that changes none of them ends the run.
    state: tuple[str, ...] = ()
    #: Columns of a message, besides src and dst.
    payload: tuple[str, ...] = ()
    #: True if every vertex is active in every step, whatever messages flow.
    always_active = False

    def edges(self, graph: Graph) -> DataFrame:
        """src, dst, and what ``message`` needs of an arc."""
        return graph.edges.select("src", "dst")

    def init(self, cfg: RunConfig, step: Step) -> dict[str, Column]:
        raise NotImplementedError

    def bootstrap(self, cfg: RunConfig) -> Column:
        """Who emits before the first step; these messages are not counted."""
        return F.lit(True)

    def message(self, step: Step) -> dict[str, Column]:
        """Payload of an arc's message, from state and edge columns."""
        raise NotImplementedError

    def gather(self, outbox: DataFrame, states: DataFrame) -> DataFrame:
        """One row per vertex with messages: dst and inbox columns."""
        raise NotImplementedError

    def gathered(self, outbox: DataFrame, states: DataFrame, step: Step) -> DataFrame:
        """The same, for programs whose plan depends on the graph's size."""
        return self.gather(outbox, states)

    def update(self, step: Step) -> dict[str, Column]:
        """New state columns, from state and inbox columns and active."""
        raise NotImplementedError

    def emits(self) -> Column:
        """Who emits after a step, from the new state, active and changed."""
        return F.col("active")

    def totals(self) -> dict[str, Column]:
        """Aggregates over all new states, for the next step."""
        return {}

    def first_totals(self) -> dict[str, Column]:
        """The same over the initial states."""
        return self.totals()

    def messages_sent(self, step: Step, along_arcs: int) -> int:
        """Messages of a step, given those along arcs."""
        return along_arcs

    def max_steps(self, n: int) -> int:
        return max(1, n)

    def observed(self) -> tuple[str, str] | None:
        """(state column, trace column) whose changes are traced."""
        return None

    def extra_messages(self, states: DataFrame, step: Step) -> DataFrame | None:
        """Messages that don't follow arcs (src, dst, payload, seq), for traces only."""
        return None
