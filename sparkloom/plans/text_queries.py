"""Queries of the text format, its errors, the command line and its output, with DuckDB SQL.

Files are written from whole tables into the shared folder and read back by the engine's
own loader.  Output is given as numbered lines, without blank ones and those that name
the file or count the machine's cores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..errors import GraphEngineError
from ..graph import Graph
from ..operators.program import RunConfig
from ..operators.superstep import checkpoint_dir, run
from ..sources.text_format import graph_lines, graph_text, load_graph, parse_graph
from . import pagerank
from .queries import _LEAST, _MOST, _labelled, _query, _ranks, _search
from .registry import PAGERANK

#: Results for inputs written here, with their SQL: no queries over tables, so tests run them.
FIXED: dict[str, tuple[Callable[[SparkSession], DataFrame], str]] = {}


def _fixed(sql: str):
    def add(f: Callable[[SparkSession], DataFrame]):
        FIXED[f.__name__] = f, sql
        return f

    return add


@contextmanager
def _file(spark: SparkSession, text: str) -> Iterator[str]:
    """A file in the shared folder, as a path with a scheme."""
    jvm = spark.sparkContext._jvm
    path = f"{checkpoint_dir(spark).rstrip('/')}/graph-{uuid.uuid4().hex}.txt"
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    try:
        yield fs.makeQualified(p).toString().replace("file:/", "file:///", 1) if fs.getScheme() == "file" else fs.makeQualified(p).toString()
    finally:
        fs.delete(p, False)


@contextmanager
def _folder(spark: SparkSession, lines: DataFrame) -> Iterator[str]:
    """Files in the shared folder that hold the lines (no, value) in order, as a path with a scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/graph-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lines.orderBy("no").select("value").write.text(path.toString())
    try:
        yield fs.makeQualified(path).toString().replace("file:/", "file:///", 1) if fs.getScheme() == "file" else fs.makeQualified(path).toString()
    finally:
        fs.delete(path, True)


def _rows(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> list[tuple]:
    """Rows of a small table, in order."""
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns).orderBy(columns[0]).collect()]


def _listed(graph: Graph) -> DataFrame:
    """list_no, src, dst, weight: the arcs in list order.

    Numbers begin anew in each range of places; the ranges' sizes, a row each, tell where.
    """
    spark = graph.spark
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = graph.edges.repartitionByRange(parts, "pos").sortWithinPartitions("pos")
    ranges = ranges.select(F.monotonically_increasing_id().alias("at"), "src", "dst", "weight").checkpoint()
    part, first, total = F.shiftright("at", 33), [], 0
    for r in ranges.groupBy(part.alias("part")).count().orderBy("part").collect():
        first.append((r.part, total))
        total += r["count"]
    starts = F.broadcast(spark.createDataFrame(first, "part long, first long"))
    number = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranges.withColumn("part", part).join(starts, "part").select(number.alias("list_no"), "src", "dst", "weight")


def _world(spark: SparkSession, sf_dir: str) -> tuple[int, list[tuple[int, int]]]:
    """Nations and their regions: vertices and arcs nation -> region."""
    r = max(k for k, in _rows(spark, sf_dir, "region", "r_regionkey")) + 1
    nations = _rows(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return r + max(k for k, _ in nations) + 1, [(k + r, up) for k, up in nations]


_WORLD = """
r AS (SELECT max(r_regionkey)::BIGINT + 1 r FROM region),
half AS (SELECT n_nationkey + r src, n_regionkey::BIGINT dst FROM nation, r),
v AS (SELECT unnest(range((SELECT r FROM r) + (SELECT max(n_nationkey) + 1 FROM nation))) id)"""
_BOTH = _WORLD + ", e AS (SELECT src, dst, 1 weight FROM half UNION ALL SELECT dst, src, 1 FROM half)"


@_query("""WITH f AS (SELECT row_number() OVER (ORDER BY o_orderkey) i, o_custkey src, o_custkey % 97 dst, o_orderkey % 1000 + 1 weight FROM orders)
SELECT (SELECT count(*) FROM f) - i AS list_no, src, dst, weight FROM f""")
def text_weighted_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted, directed file with parallel arcs: its arcs are listed from the last line to the first."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    arcs = orders.select(F.col("o_orderkey").alias("no"), F.col("o_custkey").alias("src"), (F.col("o_custkey") % 97).alias("dst"), (F.col("o_orderkey") % 1000 + 1).alias("weight"))
    n = arcs.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    with _folder(spark, graph_lines(n, arcs, weighted=True)) as path:
        return _listed(load_graph(spark, path))


@_query(f"""WITH {_WORLD}, c AS (SELECT row_number() OVER (ORDER BY c_custkey) i, c_custkey + (SELECT count(*) FROM v) src, c_nationkey + r dst FROM customer, r),
f AS (SELECT row_number() OVER (ORDER BY src) i, src, dst, 0 z FROM half UNION ALL SELECT i + (SELECT count(*) FROM half), src, dst, 0 FROM c),
g AS (SELECT (SELECT count(*) FROM f) - i p, 0 half, src, dst FROM f UNION ALL SELECT (SELECT count(*) FROM f) - i, 1, dst, src FROM f)
SELECT row_number() OVER (ORDER BY half, p) - 1 AS list_no, src, dst, 1::BIGINT AS weight FROM g""")
def text_undirected_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An undirected file with CRLF, blank lines, odd spaces: reverses come after all arcs."""
    n, arcs = _world(spark, sf_dir)
    first = spark.createDataFrame([(i - len(arcs), *a) for i, a in enumerate(arcs)], "no long, src long, dst long")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    arcs = first.unionByName(customer.select(F.col("c_custkey").alias("no"), (F.col("c_custkey") + n).alias("src"), (F.col("c_nationkey") + min(a for a, _ in arcs)).alias("dst")))
    odd = F.replace(F.replace("value", F.lit(" "), F.lit(" \t ")), F.lit("\n"), F.lit(" \r\n \r\n"))
    lines = graph_lines(arcs.agg(F.max("src")).first()[0] + 1, arcs, undirected=True).select("no", F.concat(odd, F.lit(" \r\n \r")).alias("value"))
    with _folder(spark, lines) as path:
        return _listed(load_graph(spark, path))


#: Faulty files, calls and what is said of them.
_FAULTS: list[tuple[str, list[str], str]] = [
    ("EDGES\n0 1\n", [], "Error loading graph: Missing NODES directive"),
    ("NODES 2\nEDGES\n", [], "Error loading graph: Missing EDGES section or no edges defined"),
    ("NODES 0\nEDGES\n0 1\n", [], "Error loading graph: NODES must be a positive integer: 0"),
    ("NODES x\nEDGES\n0 1\n", [], "Error loading graph: NODES must be a positive integer: x"),
    ("NODES 99999999999999999999\nEDGES\n0 1\n", [], "Error loading graph: NODES must be a positive integer: 99999999999999999999"),
    ("NODES 2\n0 1\n", [], "Error loading graph: Unknown line or outside EDGES section: 0 1"),
    ("NODES 2\n# note\nEDGES\n0 1\n", [], "Error loading graph: Unknown line or outside EDGES section: # note"),
    ("NODES 2\nEDGES\n0 1\nUNDIRECTED\n1 0\n", [], "Error loading graph: Unknown line or outside EDGES section: 1 0"),
    ("NODES 2\nEDGES\n0 1 5\n", [], "Error loading graph: Weighted edge found but WEIGHTED directive is missing: 0 1 5"),
    ("NODES 2\nEDGES\n0\n", [], "Error loading graph: Each edge must have the format: <from> <to>"),
    ("NODES 2\nWEIGHTED\nEDGES\n0 1\n", [], "Error loading graph: In WEIGHTED mode each edge must have the format: <from> <to> <weight>"),
    ("NODES 2\nWEIGHTED\nEDGES\n0 1 0\n", [], "Error loading graph: edge (weight) must be a positive integer: 0"),
    ("NODES 2\nWEIGHTED\nEDGES\n0 1 9223372036854775808\n", [], "Error loading graph: edge (weight) must be a positive integer: 9223372036854775808"),
    ("NODES 2\nEDGES\n-1 1\n", [], "Error loading graph: edge (from) must be an integer >= 0: -1"),
    ("NODES 2\nEDGES\n0 y\n", [], "Error loading graph: edge (to) must be an integer >= 0: y"),
    ("NODES 2\nEDGES\n9 0\n0 7\n", [], "Error loading graph: edge (to) 7 out of range [0, 1]"),
    ("NODES 2\nEDGES\n0 1\n", ["-s", "2"], "Error in source/target: SOURCE 2 out of range [0, 1]"),
    ("NODES 2\nEDGES\n0 1\n", ["-t", "5"], "Error in source/target: TARGET 5 out of range [0, 1]"),
    ("NODES 2\nEDGES\n0 1\n", ["-s", "x"], "--source/--target: must be an integer >= 0: x"),
    ("NODES 2\nEDGES\n0 1\n", ["-a", "BFS", "-s", "0"], "--target is required to compute a path (BFS and Bellman-Ford)"),
    ("NODES 2\nEDGES\n0 1\n", ["-a", "SSSP", "-t", "0"], "--source is required for path algorithms (BFS and Bellman-Ford)"),
    ("NODES 2\nEDGES\n0 1\n", ["-a", "DFS"], "unknown algorithm: DFS (use BFS, BELLMANFORD, PAGERANK, CC, LP)"),
    ("NODES 2\nEDGES\n0 1\n", ["--threads", "0"], "Error: --threads must be at least 1"),
]


@_fixed("SELECT no, message FROM (VALUES " + ", ".join(f"({i}, '{m}')" for i, (_, _, m) in enumerate(_FAULTS)) + ") x(no, message)")
def cli_errors(spark: SparkSession) -> DataFrame:
    """What the command line says of faulty files and arguments."""
    said = []
    for i, (text, more, _) in enumerate(_FAULTS):
        with _file(spark, text) as path:
            try:
                cli.execute(["-g", path, "-a", "CC", *more], spark)
            except GraphEngineError as e:
                said.append((i, cli.explain(e)))
    return spark.createDataFrame(said, "no int, message string")


def _call(spark: SparkSession, text: str, *arguments: str) -> DataFrame:
    with _file(spark, text) as path:
        out = cli.execute(["-g", path, "-v", *arguments], spark)
    lines = [x for x in out.split("\n") if x.strip() and not x.startswith(("  Graph:", "  Threads:"))]
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def _lines(ctes: str, name: str, source: str, target: str, steps: str, result: str, warning: str = "false") -> str:
    """SQL of the whole output; ``steps`` selects (step, active, sent), updates and messages are CTEs u and m, ``result`` (i, line)."""
    head = ["Sparkloom", f"  Source:     {source}", f"  Target:     {target}", f"  Algorithm:  {name}", "Graph loaded:"]
    tops = ", ".join(f"(0, {i}, 0, 0, 0, '{x}')" for i, x in enumerate(head))
    return f"""{ctes},
near AS (SELECT src, string_agg(dst || CASE WHEN weight = 1 THEN '' ELSE '(' || weight || ')' END, ' ' ORDER BY pos) near FROM listed GROUP BY src),
logs2 AS ({steps}),
x(a, b, c, d, f, line) AS (SELECT * FROM (VALUES {tops}) UNION ALL
  SELECT 1, 0, 0, 0, 0, '  Nodes:      ' || count(*) FROM v UNION ALL SELECT 1, 1, 0, 0, 0, '  Edges:      ' || count(*) FROM listed UNION ALL SELECT 1, 2, 0, 0, 0, '  Adjacency:' UNION ALL
  SELECT 1, 3, id, 0, 0, '    ' || id || ' -> ' || coalesce(near, '[]') FROM v LEFT JOIN near ON src = id UNION ALL
  SELECT 2, -1, 0, 0, 0, 'Pregel execution (Spark supersteps):' UNION ALL
  SELECT 2, step, 0, 0, 0, 'Superstep ' || step || ': ' || active || ' active vertices, ' || sent || ' messages sent' FROM logs2 UNION ALL
  SELECT 2, step, 1, v, 0, '    vertex ' || v || ' updated: ' || what FROM u UNION ALL
  SELECT 2, step, 2, v, dst, '    vertex ' || v || ' -> ' || dst || ': ' || what FROM m UNION ALL
  SELECT 3, 0, 0, 0, 0, 'Converged in ' || count(*) || ' supersteps.' FROM logs2 UNION ALL
  SELECT 3, 1, 0, 0, 0, 'Warning: maximum superstep limit reached.' WHERE {warning} UNION ALL
  SELECT 4, i, 0, 0, 0, line FROM ({result}))
SELECT (row_number() OVER (ORDER BY a, b, c, d, f) - 1)::INT AS line_no, line FROM x"""


_LISTED = """, fl AS (SELECT row_number() OVER (ORDER BY src) i, src, dst FROM half),
listed AS (SELECT -i pos, src, dst, 1 weight FROM fl UNION ALL SELECT 1000000 - i, dst, src, 1 FROM fl)"""
_LABEL_TEXT = """,
u AS (SELECT s.step - 1 step, s.v, 'label ' || s.label what FROM s JOIN s b ON b.v = s.v AND b.step = s.step - 1 WHERE s.label <> b.label),
m AS (SELECT s.step - 1 step, s.v, dst, 'LabelMsg {lmLabel = ' || label || '}' what FROM s JOIN e ON src = s.v WHERE act AND s.step > 0)"""
_LABEL_STEPS = "SELECT step, active_vertices active, messages_sent sent FROM logs"


@_query(_lines(_labelled(_BOTH + _LISTED, _LEAST) + _LABEL_TEXT, "ConnectedComponents", "—", "—", _LABEL_STEPS,
               "SELECT -1 i, 'Result: connected components' line UNION ALL SELECT label, '  component ' || label || ': [' || string_agg(v, ',' ORDER BY v) || ']' FROM t GROUP BY label"))
def cli_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, arcs = _world(spark, sf_dir)
    return _call(spark, graph_text(n, arcs, undirected=True), "-a", "cc")


_LABELS = "SELECT -1 i, 'Result: label propagation' line UNION ALL SELECT v, '  node ' || v || ' -> label ' || label FROM t"


@_query(_lines(_labelled(_BOTH + _LISTED, _MOST) + _LABEL_TEXT, "LabelPropagation", "—", "—", _LABEL_STEPS, _LABELS))
def cli_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, arcs = _world(spark, sf_dir)
    return _call(spark, graph_text(n, arcs, undirected=True), "--algorithm", "LabelPropagation")


_RING = [(0, 1), (0, 4), (1, 2), (1, 3), (1, 5), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)]
_RING_SQL = f"""half AS (SELECT src::BIGINT src, dst::BIGINT dst, i FROM (VALUES {", ".join(f"({a}, {b}, {i})" for i, (a, b) in enumerate(_RING))}) x(src, dst, i)),
v AS (SELECT unnest(range(6)) id), e AS (SELECT src, dst, 1 weight FROM half UNION ALL SELECT dst, src, 1 FROM half),
listed AS (SELECT -i pos, src, dst, 1 weight FROM half UNION ALL SELECT 1000000 - i, dst, src, 1 FROM half)"""


@_fixed(_lines(_labelled(_RING_SQL, _MOST) + _LABEL_TEXT, "LabelPropagation", "—", "—", _LABEL_STEPS, _LABELS, "(SELECT bool_or(state_changed) FROM logs WHERE step = 5)"))
def cli_oscillation(spark: SparkSession) -> DataFrame:
    """Labels that change for ever: the run ends at its cap and says so."""
    return _call(spark, graph_text(6, _RING, undirected=True), "-a", "LP")


@_query(_lines(_search(_BOTH + _LISTED, 0, "1") + """,
c AS (SELECT s.step, s.v, s.d FROM s JOIN s b ON b.v = s.v AND b.step = s.step - 1 WHERE s.d < b.d UNION ALL SELECT 0, 0, 0),
u AS (SELECT step - 1 step, v, 'distance ' || d what FROM c WHERE step > 0),
m AS (SELECT step - 1 step, v, dst, 'DistanceMsg {dmFrom = ' || v || ', dmDistance = ' || d || '}' what FROM c JOIN e ON src = v WHERE step > 0)""",
    "BFS", "0", "5", """SELECT k.step, (SELECT count(DISTINCT dst) FROM c JOIN e ON src = c.v WHERE c.step = k.step) active, (SELECT count(*) FROM m WHERE m.step = k.step) sent
  FROM (SELECT DISTINCT step FROM c JOIN e ON src = c.v) k""",
    """SELECT 0 i, 'Result: path found' line WHERE EXISTS (SELECT 1 FROM t WHERE v = 5 AND d IS NOT NULL) UNION ALL SELECT 0, 'Result: no path between source and target' WHERE NOT EXISTS (SELECT 1 FROM t WHERE v = 5 AND d IS NOT NULL)
  UNION ALL SELECT 1, '  Distance: ' || d FROM t WHERE v = 5 AND d IS NOT NULL UNION ALL SELECT 2, '  Path:     [' || p || ',5]' FROM t WHERE v = 5 AND d IS NOT NULL"""))  # fmt: skip
def cli_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first region to the first nation."""
    n, arcs = _world(spark, sf_dir)
    return _call(spark, graph_text(n, arcs, undirected=True), "-a", "BreadthFirstSearch", "--source", "0", "--target", "5")


@_query(_ranks(_WORLD + ", e AS (SELECT src, dst, 1 weight FROM half)") + """,
q AS (SELECT s.*, b.rank was FROM s JOIN s b ON b.v = s.v AND b.step = s.step - 1)
SELECT step - 1 AS step, 'update' AS kind, v AS from_id, NULL::BIGINT AS to_id, round(rank, 8) AS rank FROM q WHERE rank <> was
UNION ALL SELECT step - 1, 'message', v, dst, round(emit / c, 8) FROM q JOIN e ON src = v JOIN deg ON deg.src = v
UNION ALL SELECT step - 1, 'message', v, id, round(emit / n, 8) FROM q, v, n WHERE q.v NOT IN (SELECT src FROM deg)
UNION ALL SELECT step - 1, 'message', v, id, 0 FROM q, v""")
def rank_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates and messages of PageRank on nation -> region: shares along arcs, those of vertices without arcs, and the empty ones that keep all active."""
    n, arcs = _world(spark, sf_dir)
    done = run(parse_graph(spark, graph_text(n, arcs)), PAGERANK.program, RunConfig(trace=True))
    return done.trace.select("step", "kind", "from_id", "to_id", F.round("rank", 8).alias("rank"))


_STAR = [(0, 1), (0, 2), (0, 3), (3, 4), (4, 5), (4, 6), (4, 7), (5, 6), (7, 5)]


@_fixed(_ranks(f"""half AS (SELECT src::BIGINT src, dst::BIGINT dst FROM (VALUES {", ".join(map(str, _STAR))}) x(src, dst)),
v AS (SELECT unnest(range(8)) id), e AS (SELECT src, dst FROM half UNION ALL SELECT dst, src FROM half)""") + """
SELECT v AS id, round(rank, 8) AS rank, (SELECT max(step) FROM s)::INT AS supersteps, (SELECT bool_or(alive) FROM s WHERE step = (SELECT max(step) FROM s)) AS max_reached FROM t""")
def pagerank_cap(spark: SparkSession) -> DataFrame:
    """Ranks that still move when the cap of n * n steps comes."""
    done = run(parse_graph(spark, graph_text(8, _STAR, undirected=True)), PAGERANK.program)
    return pagerank.rankings(done).select("id", F.round("rank", 8).alias("rank"), F.lit(done.supersteps).alias("supersteps"), F.lit(done.max_reached).alias("max_reached"))
