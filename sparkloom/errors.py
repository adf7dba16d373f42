"""Errors of graph files, graphs, runs and the command line; ``str()`` is the message shown."""

from __future__ import annotations


class GraphEngineError(Exception):
    """Base of all errors that a user's input can cause."""


class ParseError(GraphEngineError):
    """A graph file breaks the format.

    ``kind`` names the fault (``KINDS``), ``context`` what was read (NODES, or an edge's
    from, to or weight), ``value`` the text or number at fault, ``n`` the number of nodes
    where that is what counts.
    """

    KINDS = ("missing-nodes", "no-edges", "unknown-line", "not-positive", "not-a-node", "out-of-range", "weight-without-weighted", "unweighted-edge", "weighted-edge")

    def __init__(self, message: str, kind: str, context: str | None = None, value: str | int | None = None, n: int | None = None):
        self.kind, self.context, self.value, self.n = kind, context, value, n
        super().__init__(message)


class LoadError(GraphEngineError):
    """A graph file can't be read."""

    def __init__(self, path: str, reason: str):
        self.path, self.reason = path, reason
        super().__init__(f"Could not read file {path}: {reason}")


class GraphError(GraphEngineError):
    """A graph given as data is invalid."""


class InvalidNodeCount(GraphError):
    def __init__(self, n: int):
        self.n = n
        super().__init__(f"NODES count must be a positive integer: {n}")


class EndpointOutOfRange(GraphError):
    """``end`` is 'from' or 'to'."""

    def __init__(self, end: str, node: int, n: int):
        self.end, self.node, self.n = end, node, n
        super().__init__(f"edge ({end}) {node} out of range [0, {n - 1}]")


class InvalidWeight(GraphError):
    def __init__(self, weight: int | None):
        self.weight = weight
        super().__init__(f"edge (weight) must be a positive integer: {weight}")


class RunNodeOutOfRange(GraphEngineError):
    """``role`` is 'SOURCE' or 'TARGET'."""

    def __init__(self, role: str, node: int, n: int):
        self.role, self.node, self.n = role, node, n
        super().__init__(f"{role} {node} out of range [0, {n - 1}]")


class AlgorithmError(GraphEngineError):
    """An algorithm lacks what it needs."""


class MissingSource(AlgorithmError):
    def __init__(self) -> None:
        super().__init__("--source is required for path algorithms (BFS and Bellman-Ford)")


class MissingTarget(AlgorithmError):
    def __init__(self) -> None:
        super().__init__("--target is required to compute a path (BFS and Bellman-Ford)")


class TargetNodeMissing(AlgorithmError):
    def __init__(self, node: int):
        self.node = node
        super().__init__(f"node {node} does not exist")


class CliError(GraphEngineError):
    """A command-line value is wrong."""
