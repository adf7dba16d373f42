"""Runs, results, traces and graphs as text.  Frames shown here are collected, so they should be small."""

from __future__ import annotations

from decimal import Decimal

from ..graph import Graph
from ..operators.superstep import Run
from ..plans.registry import Algorithm


def show_double(x: float) -> str:
    """Shortest digits; plain from 0.1 up to 10^7, else d.ddde<exponent>."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "-0.0" if str(x)[0] == "-" else "0.0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    minus = "-" if sign else ""
    if 0 < point <= 7:
        text = text.ljust(point, "0")
        return f"{minus}{text[:point]}.{text[point:] or '0'}"
    if point == 0:
        return f"{minus}0.{text}"
    return f"{minus}{text[0]}.{text[1:] or '0'}e{point - 1}"


def show_list(ids: list[int]) -> str:
    return "[" + ",".join(map(str, ids)) + "]"


def describe_result(run: Run, algorithm: Algorithm) -> str:
    kind = algorithm.program.kind
    if kind == "path":
        found = algorithm.result(run).first()
        if not found.found:
            return "Result: no path between source and target"
        return f"Result: path found\n  Distance: {found.distance}\n  Path:     {show_list(found.path)}\n"
    frame = algorithm.result(run)
    if kind == "components":
        head, rows = "connected components", [f"  component {r.label}: {show_list(r.members)}" for r in frame.orderBy("label").collect()]
    elif kind == "rankings":
        head, rows = "PageRank", [f"  node {r.id}: {show_double(r.rank)}" for r in frame.orderBy("id").collect()]
    else:
        head, rows = "label propagation", [f"  node {r.id} -> label {r.label}" for r in frame.orderBy("id").collect()]
    return "\n".join([f"Result: {head}", *rows]) + "\n"


def _entry(e, kind: str) -> str:
    value = {"path": e.distance, "rankings": e.rank}.get(kind, e.label)
    shown = show_double(value) if kind == "rankings" else str(value)
    if e.kind == "update":
        return f"vertex {e.from_id} updated: {'distance' if kind == 'path' else 'rank' if kind == 'rankings' else 'label'} {shown}"
    message = {
        "path": f"DistanceMsg {{dmFrom = {e.from_id}, dmDistance = {shown}}}",
        "rankings": f"RankMsg {{rmRank = {shown}}}",
    }.get(kind, f"LabelMsg {{lmLabel = {shown}}}")
    return f"vertex {e.from_id} -> {e.to_id}: {message}"


def describe_run(run: Run, algorithm: Algorithm, verbose: bool = False) -> str:
    lines: list[str] = []
    if verbose:
        entries: dict[int, list] = {}
        if run.trace is not None:
            for e in run.trace.orderBy("step", "kind_ord", "from_id", "to_id", "seq").collect():
                entries.setdefault(e.step, []).append(e)
        for log in run.logs:
            head = f"Superstep {log.step}: {log.active_vertices} active vertices, {log.messages_sent} messages sent"
            lines.append("\n".join([head, *("    " + _entry(e, algorithm.program.kind) for e in entries.get(log.step, []))]) + "\n")
        lines.append("")
    lines += [f"Converged in {run.supersteps} supersteps.", ""]
    if run.max_reached:
        lines += ["Warning: maximum superstep limit reached.", ""]
    lines.append(describe_result(run, algorithm))
    return "\n".join(lines) + "\n"


def describe_graph(graph: Graph) -> str:
    rows = []
    for r in graph.adjacency().orderBy("id").collect():
        arcs = " ".join(str(a.dst) if a.weight == 1 else f"{a.dst}({a.weight})" for a in r.neighbors)
        rows.append(f"    {r.id} -> {arcs or '[]'}")
    return "\n".join([f"  Nodes:      {graph.n}", f"  Edges:      {graph.arc_count()}", "", "\n".join(["  Adjacency:", *rows]) + "\n"]) + "\n"
