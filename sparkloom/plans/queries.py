"""The engine's operators as queries over whole tables, with DuckDB SQL for each.

Runs halt by the engine's own rules; the SQL goes on until a step changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, invalid_edges
from ..operators.program import RunConfig
from ..operators.superstep import Run, run
from ..sources import tables
from . import blocks, capacity, labels, pagerank, paths, shortcut
from .registry import BELLMAN_FORD, BFS, COMPONENTS, LABEL_PROPAGATION, PAGERANK, Algorithm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_PLACES = """
tops AS (SELECT (SELECT max(r_regionkey) + 1 FROM region) r, (SELECT max(n_nationkey) + 1 FROM nation) n, (SELECT max(c_custkey) + 1 FROM customer) c),
half AS (SELECT n_nationkey + r src, n_regionkey::BIGINT dst FROM nation, tops UNION SELECT c_custkey + r + n, c_nationkey + r FROM customer, tops),
e AS (SELECT src, dst, 1 weight FROM half UNION SELECT dst, src, 1 FROM half),
v AS (SELECT unnest(range((SELECT r + n + c FROM tops))) id)"""
_SUCCESSIONS = """
e AS (SELECT * FROM (SELECT o_custkey src, lead(o_custkey) OVER d dst,
    (floor(abs(lead(o_totalprice) OVER d - o_totalprice) / 1000) + 1)::BIGINT weight, o_orderkey pos
  FROM orders WINDOW d AS (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey)) WHERE dst IS NOT NULL),
v AS (SELECT unnest(range((SELECT max(c_custkey) + 1 FROM customer))) id)"""
_TRADE = """
tops AS (SELECT (SELECT max(s_suppkey) + 1 FROM supplier) s, (SELECT max(p_partkey) + 1 FROM part) p),
half AS (SELECT l_suppkey src, l_partkey + s dst, min(l_quantity)::BIGINT weight FROM lineitem, tops GROUP BY ALL),
e AS (SELECT src, dst, weight FROM half UNION SELECT dst, src, weight FROM half),
v AS (SELECT unnest(range((SELECT s + p FROM tops))) id)"""


def _search(graph: str, source: int, weight: str) -> str:
    """CTEs up to t(v, d, p): distance and predecessor once no step changes any; s has every step."""
    return f"""WITH RECURSIVE {graph},
s(step, v, d, p, alive) AS (
  SELECT 0, id, CASE WHEN id = {source} THEN 0 ELSE 1000000000000 END::BIGINT, NULL::BIGINT, true FROM v
  UNION ALL
  SELECT step + 1, v, d, p, bool_or(changed) OVER () FROM (
    SELECT step, v, min(d) d, nullif(min({{'d': d, 'new': new, 'p': coalesce(p, -1)}}).p, -1) p, min(d) < min(d) FILTER (new = 0) changed FROM (
      SELECT step, v, d, p, 0 new FROM s WHERE alive
      UNION ALL SELECT step, e.dst, s.d + {weight}, s.v, 1 FROM s JOIN e ON e.src = s.v WHERE alive AND s.d < 1000000000000)
    GROUP BY step, v)),
t AS (SELECT v, CASE WHEN d < 1000000000000 THEN d END d, p FROM s WHERE step = (SELECT max(step) FROM s))"""


def _query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _run(graph: Graph, algorithm: Algorithm, **config) -> Run:
    return run(graph, algorithm.program, RunConfig(**config))


@_query(f"WITH {_SUCCESSIONS} SELECT id, count(src) AS degree FROM v LEFT JOIN e ON src = id GROUP BY id")
def graph_out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.successions(spark, sf_dir).out_degrees()


@_query(f"""WITH {_SUCCESSIONS} SELECT id, coalesce(string_agg(dst || '(' || weight || ')', ' ' ORDER BY pos), '') AS neighbors
FROM v LEFT JOIN e ON src = id GROUP BY id""")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform("neighbors", lambda a: F.concat(a["dst"].cast("string"), F.lit("("), a["weight"].cast("string"), F.lit(")")))
    return tables.successions(spark, sf_dir).adjacency().select("id", F.array_join(shown, " ").alias("neighbors"))


@_query(f"WITH {_TRADE} SELECT src, dst, weight FROM e")
def graph_symmetrized_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trade(spark, sf_dir).edges.select("src", "dst", "weight")


@_query(f"WITH {_SUCCESSIONS} SELECT src, dst, arg_max(weight, pos) AS weight FROM e GROUP BY src, dst")
def graph_effective_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.successions(spark, sf_dir).effective_weights()


@_query(f"""WITH {_SUCCESSIONS} SELECT src, dst, pos, CASE WHEN src >= 100 THEN 'from' ELSE 'to' END AS fault FROM e WHERE src >= 100 OR dst >= 100""")
def graph_range_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs that a graph of 100 vertices would reject."""
    return invalid_edges(tables.successions(spark, sf_dir).edges, 100).select("src", "dst", F.col("pos.no").alias("pos"), "fault")


@_query(_search(_SUCCESSIONS, 1, "1") + " SELECT v AS id, d AS distance, p AS predecessor FROM t")
def bfs_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.distances(tables.successions(spark, sf_dir), BFS.program, 1)


def _path_sql(search: str, target: str) -> str:
    return search + f""", goal AS (SELECT {target} id),
back(v, p, path) AS (SELECT v, p, v::VARCHAR FROM t, goal WHERE v = goal.id AND d IS NOT NULL
  UNION ALL SELECT t.v, t.p, t.v || ' ' || path FROM back JOIN t ON t.v = back.p)
SELECT d IS NOT NULL AS found, d AS distance, (SELECT path FROM back WHERE p IS NULL) AS path FROM t, goal WHERE v = goal.id"""


def _shown_path(df: DataFrame) -> DataFrame:
    return df.select("found", "distance", F.array_join("path", " ").alias("path"))


@_query(_path_sql(_search(_SUCCESSIONS, 1, "1"), "(SELECT max(c_custkey) FROM customer)"))
def bfs_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.successions(spark, sf_dir)
    return _shown_path(paths.path_to(blocks.distances(g, BFS.program, 1), g.n - 1))


@_query(_search(_TRADE, 1, "e.weight") + " SELECT v AS id, d AS distance, p AS predecessor FROM t")
def sssp_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.distances(_run(tables.trade(spark, sf_dir), BELLMAN_FORD, source=1, target=1))


@_query(_search(_SUCCESSIONS.replace("e AS (", "x AS (", 1) + ", e AS (SELECT src, dst, arg_max(weight, pos) weight FROM x GROUP BY src, dst)", 1, "e.weight") + " SELECT v AS id, d AS distance, p AS predecessor FROM t")
def sssp_parallel_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of parallel arcs, the last in list order tells the weight."""
    return blocks.distances(tables.successions(spark, sf_dir), BELLMAN_FORD.program, 1)


@_query(_path_sql(_search(_TRADE, 1, "e.weight"), "(SELECT max(p_partkey) + (SELECT s FROM tops) FROM part)"))
def sssp_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.trade(spark, sf_dir)
    return _shown_path(paths.path_result(_run(g, BELLMAN_FORD, source=1, target=g.n - 1)))


@_query(_search(_PLACES, 0, "1") + """, up(v, d, p, path) AS (SELECT v, d, p, v::VARCHAR FROM t WHERE v = 0
  UNION ALL SELECT t.v, t.d, t.p, path || ' ' || t.v FROM up JOIN t ON t.p = up.v) SELECT v AS id, d AS distance, path FROM up""")
def bfs_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _run(tables.places(spark, sf_dir), BFS, source=0, target=0)
    return paths.all_paths(done.states, 0).select("id", "distance", F.array_join("path", " ").alias("path"))


def _labelled(graph: str, new: str, cap: str = "(SELECT greatest(1, count(*)) FROM v)") -> str:
    """CTEs up to t(v, label) for label programs; s has every step, with who was active and whether any label changed.

    ``new`` selects (v, label) of the active vertices from s and e; vertices without messages
    keep their labels and stay silent.
    """
    return f"""WITH RECURSIVE {graph}, s(step, v, label, act, alive) AS (SELECT 0, id, id, true, true FROM v UNION ALL
  SELECT step + 1, v, new, act, bool_or(new <> label) OVER () FROM (
    SELECT s.step, s.v, s.label, coalesce(w.label, s.label) new, w.label IS NOT NULL act, bool_or(w.label IS NOT NULL) OVER () messages
    FROM s LEFT JOIN ({new}) w ON w.v = s.v WHERE s.alive AND s.step < {cap}) WHERE messages),
t AS (SELECT v, label FROM s WHERE step = (SELECT max(step) FROM s)),
logs AS (SELECT (step - 1)::INT AS step, count(*) FILTER (act) AS active_vertices, coalesce(sum(c) FILTER (act), 0)::BIGINT AS messages_sent, bool_or(alive) AS state_changed
  FROM s LEFT JOIN (SELECT src, count(*) c FROM e GROUP BY src) ON src = v WHERE step > 0 GROUP BY step)"""


_LEAST = "SELECT x.v, least(x.label, min(y.label)) label FROM s x JOIN e ON e.dst = x.v JOIN s y ON y.v = e.src WHERE y.act GROUP BY x.v, x.label"
_MOST = """SELECT v, label FROM (SELECT v, label, row_number() OVER (PARTITION BY v ORDER BY count(*) DESC, label) k FROM (
      SELECT e.dst v, s.label FROM s JOIN e ON e.src = s.v WHERE s.act
      UNION ALL SELECT s.v, s.label FROM s WHERE s.v IN (SELECT e.dst FROM s JOIN e ON e.src = s.v WHERE s.act)) GROUP BY v, label)
    WHERE k = 1"""


def _components(graph: str) -> str:
    return _labelled(graph, _LEAST)


@_query(_components(_SUCCESSIONS) + " SELECT v AS id, label FROM t")
def cc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along arcs only: the least id that reaches a vertex."""
    return labels.labels(_run(tables.successions(spark, sf_dir), COMPONENTS))


@_query(_components(_PLACES) + " SELECT label, string_agg(v, ' ' ORDER BY v) AS members FROM t GROUP BY label")
def cc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.components(_run(tables.places(spark, sf_dir), COMPONENTS)).select("label", F.array_join("members", " ").alias("members"))


def _propagation(graph: str) -> str:
    return _labelled(graph, _MOST)


@_query(_propagation(_SUCCESSIONS) + " SELECT v AS id, label FROM t")
def lp_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labels(_run(tables.successions(spark, sf_dir), LABEL_PROPAGATION))


@_query(f"""WITH {_SUCCESSIONS}, w AS (SELECT v, label, row_number() OVER (PARTITION BY v ORDER BY count(*) DESC, label) k FROM (
  SELECT dst v, src AS label FROM e UNION ALL SELECT id, id FROM v) GROUP BY v, label)
SELECT v AS id, v AS label, label AS wanted FROM w WHERE k = 1 AND label <> v""")
def lp_unstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices that would leave their own label if all in-neighbours voted with theirs."""
    g = tables.successions(spark, sf_dir)
    return labels.unstable(g, g.vertices().select("id", F.col("id").alias("label")))


def _exact(x: str) -> str:
    """The sum that is the same in any order: integers of 2^-52, and of 2^-82 for the rest."""
    return f"(sum(floor({x} * 4503599627370496e0)::BIGINT)::DOUBLE / 4503599627370496e0 + sum(floor(({x} * 4503599627370496e0 - floor({x} * 4503599627370496e0)) * 1073741824e0)::BIGINT)::DOUBLE / 4835703278458516698824704e0)"


def _ranks(graph: str, cap: str = "(SELECT greatest(50, n * n) FROM n)") -> str:
    """CTEs up to s(step, v, rank, emit, alive) until no rank moves by more than 1e-9, or the cap; bit for bit the engine's."""
    return f"""WITH RECURSIVE {graph}, n AS (SELECT count(*) n FROM v), deg AS (SELECT src, count(*) c FROM e GROUP BY src),
s(step, v, rank, emit, alive) AS (SELECT 0, id, 1.0::DOUBLE / n, 1.0::DOUBLE / n, true FROM v, n UNION ALL
  SELECT step + 1, v, CASE WHEN abs(new - rank) <= 1e-9 THEN rank ELSE new END, new, bool_or(abs(new - rank) > 1e-9) OVER () FROM (
    SELECT s.step, s.v, s.rank, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(m.got, 0) + coalesce(loose, 0) / n) new
    FROM s LEFT JOIN (SELECT e.dst, {_exact('s.emit / c')} got FROM s JOIN e ON e.src = s.v JOIN deg ON deg.src = s.v GROUP BY e.dst) m ON m.dst = s.v,
      n, (SELECT {_exact('emit')} loose FROM s WHERE v NOT IN (SELECT src FROM deg)) WHERE s.alive AND s.step < {cap})),
t AS (SELECT v, rank FROM s WHERE step = (SELECT max(step) FROM s))"""


@_query(_ranks(_SUCCESSIONS) + " SELECT v AS id, round(rank, 8) AS rank FROM t")
def pagerank_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _run(tables.successions(spark, sf_dir), PAGERANK)
    return pagerank.rankings(done).select("id", F.round("rank", 8).alias("rank"))


@_query(_components(_SUCCESSIONS) + " SELECT * FROM logs")
def cc_supersteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(tables.successions(spark, sf_dir), COMPONENTS).log_frame()


@_query(_propagation(_SUCCESSIONS) + " SELECT * FROM logs")
def lp_supersteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(tables.successions(spark, sf_dir), LABEL_PROPAGATION).log_frame()


@_query(_search(_PLACES, 0, "1") + """, reached AS (SELECT v, min(step) k, min(d) d FROM s WHERE d < 1000000000000 GROUP BY v)
SELECT k - 1 AS step, 'update' AS kind, v AS from_id, NULL::BIGINT AS to_id, d AS distance FROM reached WHERE k > 0
UNION ALL SELECT k - 1, 'message', v, e.dst, d FROM reached JOIN e ON e.src = v WHERE k > 0""")
def bfs_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates and messages of all steps."""
    done = _run(tables.places(spark, sf_dir), BFS, source=0, target=0, trace=True)
    return done.trace.select("step", "kind", "from_id", "to_id", "distance")


#: How a run ended: at the cap, if the last step still changed something.
_ENDED = "(SELECT max(step) FROM s)::INT AS supersteps, (SELECT bool_or(alive) FROM s WHERE step = (SELECT max(step) FROM s)) AS max_reached"


@_query("""WITH RECURSIVE tops AS (SELECT max(s_suppkey) + 1 s FROM supplier),
x AS (SELECT l_suppkey a, l_partkey + s b, l_quantity::BIGINT w FROM lineitem, tops),
e AS (SELECT a, b, min(w) w FROM x GROUP BY ALL) SELECT a AS src, b AS dst, w AS weight FROM e UNION ALL SELECT b, a, w FROM e""")
def graph_lightest_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected, unlisted parallel arcs given either way: the lightest counts, both ways."""
    return tables.shipments(spark, sf_dir).effective_weights()


@_query(_search(_PLACES, 0, "1").replace("WHERE alive\n", "WHERE alive AND step < 2\n").replace("WHERE alive AND s.d", "WHERE alive AND s.step < 2 AND s.d") + f" SELECT v AS id, d AS distance, p AS predecessor, {_ENDED} FROM t")
def bfs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ends at its cap just when all is found is flagged."""
    return _flagged(_run(tables.places(spark, sf_dir), BFS, source=0, target=0, max_steps=2), paths.distances)


def _flagged(done: Run, result) -> DataFrame:
    return result(done).select("*", F.lit(done.supersteps).alias("supersteps"), F.lit(done.max_reached).alias("max_reached"))


@_query(_labelled(_TRADE, _MOST, "3") + f" SELECT v AS id, label, {_ENDED} FROM t")
def lp_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label propagation on a bipartite graph, stopped by its cap."""
    return _flagged(_run(tables.trade(spark, sf_dir), LABEL_PROPAGATION, max_steps=3), labels.labels)


@_query(_ranks(_PLACES, "12") + f" SELECT v AS id, round(rank, 12) AS rank, {_ENDED} FROM t")
def pagerank_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _flagged(_run(tables.places(spark, sf_dir), PAGERANK, max_steps=12), pagerank.rankings)
    return done.withColumn("rank", F.round("rank", 12))


@_query(_ranks(_SUCCESSIONS) + f" SELECT v AS id, round(rank, 12) AS rank, {_ENDED} FROM t")
def pagerank_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the halt: stored ranks stay where they last moved by more than 1e-9."""
    done = _flagged(_run(tables.successions(spark, sf_dir), PAGERANK), pagerank.rankings)
    return done.withColumn("rank", F.round("rank", 12))


@_query(_labelled(_PLACES, _MOST, "3") + """ SELECT (a.step - 1)::INT AS step, 'update' AS kind, a.v AS from_id, NULL::BIGINT AS to_id, a.label FROM s a JOIN s b ON b.v = a.v AND b.step = a.step - 1 WHERE a.label <> b.label
UNION ALL SELECT (step - 1)::INT, 'message', v, dst, label FROM s JOIN e ON src = v WHERE step > 0 AND act""")
def lp_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label updates and messages of the first steps."""
    done = _run(tables.places(spark, sf_dir), LABEL_PROPAGATION, max_steps=3, trace=True)
    return done.trace.select("step", "kind", "from_id", "to_id", "label")


@_query(_ranks(_PLACES, "6") + " SELECT (a.step - 1)::INT AS step, a.v AS id, round(a.rank, 12) AS rank FROM s a JOIN s b ON b.v = a.v AND b.step = a.step - 1 WHERE a.rank <> b.rank")
def rank_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that moved, by step."""
    done = _run(tables.places(spark, sf_dir), PAGERANK, max_steps=6, trace=True, trace_messages=False)
    return done.trace.select("step", F.col("from_id").alias("id"), F.round("rank", 12).alias("rank"))


@_query(_components(_PLACES) + " SELECT label, v // 1000 AS page_no, string_agg(v, ' ' ORDER BY v) AS members FROM t GROUP BY ALL")
def cc_member_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by hooking and compressing, listed in pages."""
    found = shortcut.undirected_components(tables.places(spark, sf_dir)).labels
    return labels.component_pages(found, 1000).select("label", "page_no", F.array_join("members", " ").alias("members"))


@_query(f"""WITH RECURSIVE {_TRADE}, s(step, v, c, alive) AS (SELECT 0, id, CASE WHEN id = 1 THEN {capacity.WHOLE} ELSE 0 END::BIGINT, true FROM v UNION ALL
  SELECT step + 1, v, greatest(c, new), bool_or(new > c) OVER () FROM (SELECT s.step, s.v, s.c, coalesce(m.w, 0) new
    FROM s LEFT JOIN (SELECT dst, max(least(c, weight)) w FROM s JOIN e ON src = v GROUP BY dst) m ON m.dst = s.v WHERE s.alive))
SELECT v AS id, c AS capacity FROM s WHERE step = (SELECT max(step) FROM s)""")
def widest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of one's own, none of the registry's."""
    return run(tables.trade(spark, sf_dir), capacity.WidestPaths(), RunConfig(source=1)).states.select("id", "capacity")
