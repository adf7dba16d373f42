"""Algorithms by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import CliError, MissingSource, MissingTarget
from ..operators.program import VertexProgram
from ..operators.superstep import Run
from . import labels, pagerank, paths


@dataclass(frozen=True)
class Algorithm:
    program: VertexProgram
    result: Callable[[Run], DataFrame]
    needs_path: bool = False

    @property
    def name(self) -> str:
        return self.program.name

    def check(self, source: int | None, target: int | None) -> None:
        """Path algorithms need both ends; the target is asked for first."""
        if self.needs_path and target is None:
            raise MissingTarget
        if self.needs_path and source is None:
            raise MissingSource


BFS = Algorithm(paths.BFS(), paths.path_result, True)
BELLMAN_FORD = Algorithm(paths.BellmanFord(), paths.path_result, True)
PAGERANK = Algorithm(pagerank.PageRank(), pagerank.rankings)
COMPONENTS = Algorithm(labels.ConnectedComponents(), labels.components)
LABEL_PROPAGATION = Algorithm(labels.LabelPropagation(), labels.labels)

#: The names a user may give, in any case.
NAMES: dict[str, Algorithm] = {
    "BFS": BFS, "BREADTHFIRSTSEARCH": BFS,
    "BELLMANFORD": BELLMAN_FORD, "BELLMAN-FORD": BELLMAN_FORD, "SSSP": BELLMAN_FORD,
    "PAGERANK": PAGERANK,
    "CONNECTEDCOMPONENTS": COMPONENTS, "CC": COMPONENTS,
    "LABELPROPAGATION": LABEL_PROPAGATION, "LP": LABEL_PROPAGATION,
}


def resolve(name: str) -> Algorithm:
    found = NAMES.get(name.upper())
    if found is None:
        raise CliError(f"unknown algorithm: {name} (use BFS, BELLMANFORD, PAGERANK, CC, LP)")
    return found
