"""Shortest paths by blocks of vertices, where only the last states are asked for.

A superstep carries a message over one arc, so a run takes as many steps as the longest of
the shortest paths has arcs, which may grow with the graph.  Here vertices lie in blocks of
consecutive ids with about a million arcs; a round goes on within every block that has
messages until nothing changes there, and only then sends to the other blocks.  Rounds grow
with the blocks that a path enters, and each reads the blocks that have messages.

The states are those of the supersteps.  Lengths are positive, so a vertex gets its last
distance in the step that is the least number of arcs of its shortest paths, from those
neighbours that have theirs one step before; of these the smallest is its predecessor.  So
the state is the least (distance, arcs, predecessor), in whatever order messages arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MissingSource
from ..graph import Graph
from ..operators.program import RunConfig
from ..operators.state_log import ROWS, Folder, dealt
from ..operators.superstep import run
from .paths import BFS
from .paths import distances as of_run

#: A block may have so many times ROWS arcs; graphs with larger ones go by supersteps.
SKEW = 4
#: Rows that a block's arcs are dealt into.
CHUNKS = 8

ROW = "block int, kind string, data binary"
FILES = "data binary, round int, kind string, block int"
ARC = np.dtype([("src", "<i8"), ("dst", "<i8"), ("length", "<i8")])
#: A message, and, with dst for the vertex itself, a state; far is its number of arcs, and src is -1 at the source.
MESSAGE = np.dtype([("dst", "<i8"), ("distance", "<i8"), ("far", "<i8"), ("src", "<i8")])
NEVER = np.iinfo(np.int64).max


def _pack(key: tuple, arcs: pd.DataFrame) -> pd.DataFrame:
    rows = np.empty(len(arcs), ARC)
    for k in ARC.names:
        rows[k] = arcs[k].to_numpy()
    return pd.DataFrame([(key[0], "arcs", rows.tobytes())], columns=["block", "kind", "data"])


def _along(arcs: np.ndarray, state: np.ndarray, lo: int) -> np.ndarray:
    """The messages along these arcs."""
    at = state[arcs["src"] - lo]
    if (at["distance"] > NEVER - 1 - arcs["length"]).any():
        raise OverflowError("long overflow in a path's length")
    out = np.empty(len(arcs), MESSAGE)
    out["dst"], out["distance"], out["far"], out["src"] = arcs["dst"], at["distance"] + arcs["length"], at["far"] + 1, arcs["src"]
    return out


def _least(messages: np.ndarray) -> np.ndarray:
    """The least message to every vertex."""
    m = messages[np.lexsort((messages["src"], messages["far"], messages["distance"], messages["dst"]))]
    return m[np.r_[True, m["dst"][1:] != m["dst"][:-1]]] if len(m) else m


def _take(state: np.ndarray, messages: np.ndarray, lo: int) -> np.ndarray:
    """Puts better messages into the states; returns the places of vertices whose distance or number of arcs is new."""
    old = state[messages["dst"] - lo]
    same, as_far = messages["distance"] == old["distance"], messages["far"] == old["far"]
    nearer = (messages["distance"] < old["distance"]) | (same & (messages["far"] < old["far"]))
    best = _least(messages[nearer | (same & as_far & (messages["src"] < old["src"]))])
    at = best["dst"] - lo
    new = (state["distance"][at] != best["distance"]) | (state["far"][at] != best["far"])
    state[at] = best
    return at[new]


def relax(state: np.ndarray, arcs: np.ndarray, inbox: np.ndarray, lo: int) -> np.ndarray:
    """Goes on within a block until nothing changes, in ``state``; returns the messages to others, arcs being sorted by src.

    Vertices near the source go first, so that few send twice.
    """
    inside = (arcs["dst"] >= lo) & (arcs["dst"] < lo + len(state))
    inner, outer = arcs[inside], arcs[~inside]
    starts = np.searchsorted(inner["src"], np.arange(lo, lo + len(state) + 1))
    stride = inner["length"].mean() if len(inner) else 0
    pending, changed = np.zeros(len(state), bool), np.zeros(len(state), bool)
    new = _take(state, inbox, lo)
    while True:
        pending[new] = changed[new] = True
        waiting = np.flatnonzero(pending)
        if not len(waiting):
            break
        away = state["distance"][waiting]
        now = waiting[away - away.min() <= stride]
        pending[now] = False
        first, many = starts[now], starts[now + 1] - starts[now]
        places = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        new = _take(state, _along(inner[places], state, lo), lo)
    return _least(_along(outer[changed[outer["src"] - lo]], state, lo))


def _round(size: int, n: int):
    """What a block with messages does in a round."""

    def go(block: int, rows: pd.DataFrame) -> pd.DataFrame:
        def held(kind: str, dtype: np.dtype) -> np.ndarray:
            return np.concatenate([np.empty(0, dtype), *(np.frombuffer(x, dtype) for x in rows["data"][rows["kind"] == kind])])

        lo = block * size
        state = held("states", MESSAGE)
        if not len(state):
            state = np.empty(min(n - lo, size), MESSAGE)
            state["dst"], state["distance"], state["far"], state["src"] = np.arange(lo, lo + len(state)), NEVER, NEVER, NEVER
        arcs = held("arcs", ARC)
        sent = relax(state, arcs[np.argsort(arcs["src"], kind="stable")], held("inbox", MESSAGE), lo)
        out = [(block, "states", state.tobytes())]
        to = sent["dst"] // size
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else []
        out += [(int(to[a]), "inbox", sent[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(to)])]
        return pd.DataFrame(out, columns=["block", "kind", "data"])

    return go


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for data in rows["data"]:
            s = np.frombuffer(data, MESSAGE)
            reached = s["distance"] != NEVER
            nulls = {"distance": ~reached, "src": ~reached | (s["src"] < 0)}
            yield pd.DataFrame({"id": s["dst"], **{k: pd.arrays.IntegerArray(s[c].astype("int64"), nulls[c]) for k, c in (("distance", "distance"), ("predecessor", "src"))}})


def distances(graph: Graph, program: BFS, source: int | None) -> DataFrame:
    """id, distance, predecessor of every vertex, as ``program`` ends with them."""
    if source is None:
        raise MissingSource
    graph.check_run_nodes(source, None)
    spark, n, folder = graph.spark, graph.n, Folder(graph.spark)
    rows = graph.arc_count()
    # of parallel arcs one is enough: all have the weight that counts
    count = max(1, -(-max(rows, n) // ROWS))
    size = -(-n // count)
    with dealt(spark, rows) as parts:
        arcs = folder.kept(program.lengths(graph).withColumn("block", F.floor(F.col("src") / size).cast("int")), "lengths")
        most = arcs.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        if most > SKEW * ROWS:
            return of_run(run(graph, program, RunConfig(source=source, target=source)))
        path = folder.new("blocks")
        # in chunks, which are dealt out evenly where whole blocks would meet in a task
        chunk = F.pmod(F.xxhash64("src", "dst"), F.lit(CHUNKS))
        arcs.groupBy("block", chunk.alias("chunk")).applyInPandas(_pack, ROW).write.partitionBy("kind", "block").parquet(f"{path}/round=-1")

    def go(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return step(int(key[0]), rows)

    def read(*paths: str) -> DataFrame:
        return spark.read.schema(FILES).option("basePath", path).parquet(*paths)

    step, number = _round(size, n), 0
    with_arcs = {r.block for r in read(f"{path}/round=-1").select("block").distinct().collect()}
    held: dict[int, str] = {}
    first = np.array([(source, 0, 0, -1)], MESSAGE).tobytes()
    spark.createDataFrame([(source // size, "inbox", first)], ROW).write.partitionBy("kind", "block").parquet(f"{path}/round=0")
    active = [source // size]
    while active:
        inbox = f"{path}/round={number}/kind=inbox"
        wanted = [inbox, *(f"{path}/round=-1/kind=arcs/block={b}" for b in active if b in with_arcs), *(held[b] for b in active if b in held)]
        dealt_out = read(*wanted).select("block", "kind", "data").repartition(min(len(active), 4 * parts), "block")
        number += 1
        dealt_out.groupBy("block").applyInPandas(go, ROW).write.partitionBy("kind", "block").parquet(f"{path}/round={number}")
        for old in (inbox, *(held[b] for b in active if b in held)):
            folder.delete(old)
        held.update((b, f"{path}/round={number}/kind=states/block={b}") for b in active)
        active = sorted(r.block for r in read(f"{path}/round={number}").filter("kind = 'inbox'").select("block").distinct().collect())
    told = read(*held.values()).select("data").mapInPandas(_told, "id long, distance long, predecessor long")
    none = F.lit(None).cast("long")
    rest = graph.vertices().filter(~F.floor(F.col("id") / size).cast("int").isin(list(held)))
    return told.unionByName(rest.select("id", none.alias("distance"), none.alias("predecessor")))
