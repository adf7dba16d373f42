import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fixtures import COMPONENTS, DANGLING, model
from sparkloom.graph import Graph
from sparkloom.operators import state_log, superstep
from sparkloom.operators.program import RunConfig
from sparkloom.operators.superstep import run
from sparkloom.plans import labels, paths
from sparkloom.plans.capacity import WHOLE, WidestPaths
from sparkloom.plans.registry import BELLMAN_FORD, BFS, LABEL_PROPAGATION, PAGERANK
from sparkloom.plans.shortcut import undirected_components
from sparkloom.sources.text_format import parse_graph


def chain(spark, n):
    return Graph.from_edges(spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst"), n)


def executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def scans(spark, since):
    """(partitions, rows) read by each scan of Parquet folders, for the executions from number ``since`` on."""
    store, found = spark._jsparkSession.sharedState().statusStore(), []
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    all_runs = store.executionsList()
    for i in range(since, all_runs.size()):
        run_id = all_runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run_id), store.planGraph(run_id).allNodes()
        for k in range(nodes.size()):
            node, got = nodes.apply(k), {}
            for m in range(node.metrics().size()):
                metric = node.metrics().apply(m)
                if values.contains(metric.accumulatorId()):
                    got[metric.name()] = values.apply(metric.accumulatorId())
            if "number of partitions read" in got:
                found.append((int(got["number of partitions read"].replace(",", "")), int(got["number of output rows"].replace(",", ""))))
    return found


def test_written_bytes_follow_the_changed_vertices(spark, monkeypatch):
    """A chain of 10,000: each step changes one vertex, writes that one, and is one action."""
    monkeypatch.setattr(state_log, "BLOCK", 100)
    monkeypatch.setattr(superstep, "LEAST", 0)
    written, append = [], state_log.StateLog.append

    def weighed(self, changed):
        before = executions(spark)
        append(self, changed)
        folder = self.parts[-1][1].removeprefix("file:")
        files = [f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet")]
        written.append((sum(pq.read_metadata(f).num_rows for f in files), sum(map(os.path.getsize, files)), executions(spark) - before))

    monkeypatch.setattr(state_log.StateLog, "append", weighed)
    done = run(chain(spark, 10_000), BFS.program, RunConfig(0, 0, 6))
    assert [rows for rows, _, _ in written] == [1] * 6
    assert max(size for _, size, _ in written) < 20_000
    assert [n for _, _, n in written] == [1] * 6
    assert [(x.active_vertices, x.messages_sent) for x in done.logs] == [(1, 1)] * 6
    assert [tuple(r) for r in done.states.filter("distance IS NOT NULL").orderBy("id").select("id", "distance", "predecessor").collect()] == [(0, 0, None)] + [(i, i, i - 1) for i in range(1, 7)]
    assert done.states.count() == 10_000


def test_few_emitters_read_their_blocks(spark, monkeypatch, tmp_path):
    """Ten emitters in ten of a hundred blocks: their arcs, and their targets' states, are what is read."""
    monkeypatch.setattr(state_log, "BLOCK", 100)
    n = 10_000
    folder = state_log.Folder(spark)
    edges = spark.range(n).selectExpr("id AS src", f"(id + 100) % {n} AS dst")
    arcs = state_log.BlockArcs(folder, edges, n)
    states = spark.range(n).selectExpr("id", "1L AS degree", "id AS label", "id % 1000 = 7 AS emits")
    log = state_log.StateLog.write(folder, states, n)
    log.append(log.frontier())
    since = executions(spark)
    sent = arcs.sent(log.frontier().drop("emits"), {"label": F.col("label")}, 10).collect()
    assert sorted((r.src, r.dst, r.label) for r in sent) == [(i, (i + 100) % n, i) for i in range(7, n, 1000)]
    assert [x for x in scans(spark, since) if x[0] == 10] == [(10, 1000)]
    since = executions(spark)
    inbox = spark.createDataFrame([(r.dst, r.label) for r in sent], "dst long, least long")
    got = log.of(inbox, 10).collect()
    assert sorted((r.id, r.label, r.least) for r in got) == [((i + 100) % n, (i + 100) % n, i) for i in range(7, n, 1000)]
    assert (10, 1000) in scans(spark, since)


def test_versions_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(state_log, "BLOCK", 7)
    monkeypatch.setattr(state_log, "KEEP", 3)
    folder, rng = state_log.Folder(spark), random.Random(1)
    want = {i: 0 for i in range(50)}
    log = state_log.StateLog.write(folder, spark.range(50).selectExpr("id", "0L AS degree", "0L AS label", "false AS emits"), 50)
    for k in range(1, 7):
        new = {rng.randrange(50): k for _ in range(8)}
        want |= new
        log.append(spark.createDataFrame([(i, 0, v, True) for i, v in new.items()], "id long, degree long, label long, emits boolean"))
        assert {r.id: r.label for r in log.states().collect()} == want
        assert {r.id for r in log.frontier().collect()} == set(new)
        asked = spark.createDataFrame([(3, "x"), (9, "y")], "dst long, m string")
        assert {(r.id, r.label, r.m) for r in log.of(asked, 2).collect()} == {(3, want[3], "x"), (9, want[9], "y")}
        assert len(log.parts) <= 4
    assert len([f for f in os.listdir(folder.path.removeprefix("file:")) if f.startswith("states")]) == 1


def test_all_steps_through_the_log(spark, monkeypatch):
    """Without broadcasts, with a new base after every part; test_algorithms has the other way."""
    from test_algorithms import check

    for where, name, value in ((superstep, "LEAST", 0), (superstep, "SPARSE", 1e-9), (state_log, "BLOCK", 3), (state_log, "KEEP", 1), (state_log, "FEW", 0)):
        monkeypatch.setattr(where, name, value)
    for name in ("bfs", "cc", "lp"):
        check(parse_graph(spark, COMPONENTS), name, 0)


def test_traces_are_one_scan(spark):
    g = parse_graph(spark, COMPONENTS)
    plans = []
    for cap in (1, 3):
        done = run(g, LABEL_PROPAGATION.program, RunConfig(max_steps=cap, trace=True))
        plans.append(done.trace._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        assert {r.step for r in done.trace.select("step").distinct().collect()} == set(range(cap))
    assert plans == [1, 1]


def test_ranks_are_the_same_in_any_partitions(spark):
    """Bit for bit, as are the steps; against the model to 1e-12 and its very step."""
    rng = random.Random(3)
    arcs = [(rng.randrange(12), rng.randrange(12), 1) for _ in range(30)]
    found = []
    for parts in ("1", "2", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            g = Graph.from_edges(spark.createDataFrame(arcs, "src long, dst long, weight long").repartition(int(parts)), 12)
            done = run(g, PAGERANK.program, RunConfig(max_steps=15))
            found.append((done.supersteps, [r.rank for r in done.states.orderBy("id").collect()]))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    states, steps, _, _ = model(12, arcs, "pagerank", cap=15)
    assert steps == found[0][0] and found[0][1] == pytest.approx([states[v] for v in range(12)], abs=1e-12)


def test_exact_sums(spark):
    from sparkloom.plans.pagerank import exact_sum

    rng = random.Random(0)
    x = [rng.random() ** 9 for _ in range(500)] + [1e-300, 0.0, 1.0]
    sums = set()
    for parts in (1, 3, 8):
        rng.shuffle(x)
        sums.add(spark.createDataFrame([(v,) for v in x], "x double").repartition(parts).agg(exact_sum(F.col("x")).alias("s")).first().s)
    assert len(sums) == 1 and sums.pop() == pytest.approx(sum(sorted(x)), abs=1e-13)


def test_unlisted_and_far_places(spark):
    """Opposite arcs without pos: the lightest counts both ways; pos may be any long."""
    arcs = [(0, 1, 5), (1, 0, 9), (1, 2, 7), (1, 2, 3)]
    g = Graph.from_edges(spark.createDataFrame(arcs, "src long, dst long, weight long"), 3, undirected=True)
    assert {tuple(r) for r in g.effective_weights().collect()} == {(0, 1, 5), (1, 0, 5), (1, 2, 3), (2, 1, 3)}
    done = run(g, BELLMAN_FORD.program, RunConfig(0, 2))
    assert tuple(BELLMAN_FORD.result(done).first()) == (True, 8, [0, 1, 2])
    top = (1 << 63) - 1
    placed = [(0, 1, 5, top), (1, 0, 9, -top - 1), (0, 1, 4, 1 << 61)]
    g = Graph.from_edges(spark.createDataFrame(placed, "src long, dst long, weight long, pos long"), 2, undirected=True)
    assert [(r.src, r.dst, r.weight) for r in g.edges.orderBy("pos").collect()] == [(1, 0, 9), (0, 1, 4), (0, 1, 5), (0, 1, 9), (1, 0, 4), (1, 0, 5)]
    assert {tuple(r) for r in g.effective_weights().collect()} == {(0, 1, 9), (1, 0, 5)}


def test_all_paths_of_a_long_chain(spark):
    n = 2000
    states = spark.range(n).selectExpr("id", "id AS distance", "CASE WHEN id > 0 THEN id - 1 END AS predecessor")
    before = executions(spark)
    found = paths.all_paths(states, 0)
    assert executions(spark) - before < 20
    assert {(r.id, len(r.path), r.path[0], r.path[-1]) for r in found.collect()} == {(i, i + 1, 0, i) for i in range(n)}
    assert found.filter(f"id = {n - 1}").first().path == list(range(n))


def test_hooked_components(spark):
    found = undirected_components(Graph.from_edges(spark.range(1999).selectExpr("id AS src", "id + 1 AS dst"), 2001, undirected=True))
    assert found.rounds == 1 and found.jumps < 14
    assert {tuple(r) for r in found.labels.collect()} == {(i, 0 if i < 2000 else 2000) for i in range(2001)}
    rng = random.Random(2)
    arcs = [(rng.randrange(60), rng.randrange(60), 1) for _ in range(45)]
    both = arcs + [(b, a, w) for a, b, w in arcs]
    g = Graph.from_edges(spark.createDataFrame(arcs, "src long, dst long, weight long"), 60, undirected=True)
    want = model(60, both, "cc")[0]
    assert {r.id: r.label for r in undirected_components(g).labels.collect()} == want


def test_pages(spark):
    """A list longer than a page spreads over rows, in order."""
    pages = labels.component_pages(spark.range(25).selectExpr("id", "0L AS label"), 10).orderBy("page_no").collect()
    assert [(r.label, r.page_no, r.members) for r in pages] == [(0, 0, list(range(10))), (0, 1, list(range(10, 20))), (0, 2, list(range(20, 25)))]
    arcs = [(0, i % 5, i + 1, -i) for i in range(40)] + [(3, 3, 1, 0)]
    g = Graph.from_edges(spark.createDataFrame(arcs, "src long, dst long, weight long, pos long"), 5)
    rows = g.adjacency_pages(6).orderBy("id", "page_no").collect()
    assert max(len(r.neighbors) for r in rows) <= 6 and len(rows) > 7
    listed = {k: [(a.dst, a.weight) for r in rows if r.id == k for a in r.neighbors] for k in (0, 3)}
    assert listed == {r.id: [(a.dst, a.weight) for a in r.neighbors] for r in g.adjacency().filter("id IN (0, 3)").collect()}


def test_own_program(spark):
    arcs = [(0, 1, 5), (1, 2, 3), (0, 2, 2), (2, 3, 9), (3, 1, 4)]
    g = Graph.from_edges(spark.createDataFrame(arcs, "src long, dst long, weight long"), 5)
    done = run(g, WidestPaths(), RunConfig(source=0))
    assert {r.id: r.capacity for r in done.states.collect()} == {0: WHOLE, 1: 5, 2: 3, 3: 3, 4: 0}


def test_dangling_ranks_match_the_model(spark):
    done = run(parse_graph(spark, DANGLING), PAGERANK.program, RunConfig(max_steps=30))
    arcs = [(r.src, r.dst, r.weight) for r in parse_graph(spark, DANGLING).edges.orderBy("pos").collect()]
    states, steps, _, _ = model(4, arcs, "pagerank", cap=30)
    assert done.supersteps == steps and [r.rank for r in done.states.orderBy("id").collect()] == pytest.approx([states[v] for v in range(4)], abs=1e-12)
