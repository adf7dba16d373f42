import random

import pytest

from fixtures import COMMUNITIES, COMPONENTS, DANGLING, DISCONNECTED, SIMPLE, WEIGHTED, model
from sparkloom.operators.program import RunConfig
from sparkloom.operators.superstep import run
from sparkloom.plans import labels, paths
from sparkloom.plans.registry import BELLMAN_FORD, BFS, COMPONENTS as CC, LABEL_PROPAGATION, PAGERANK
from sparkloom.sources.text_format import parse_graph

MODELS = {"bfs": BFS, "sssp": BELLMAN_FORD, "cc": CC, "lp": LABEL_PROPAGATION, "pagerank": PAGERANK}


def listed(graph):
    return [(r.src, r.dst, r.weight) for r in graph.edges.orderBy("pos").collect()]


def check(graph, name, source=None, cap=None):
    states, steps, logs, reached = model(graph.n, listed(graph), name, source, cap)
    done = run(graph, MODELS[name].program, RunConfig(source, 0, cap))
    rows = done.states.orderBy("id").collect()
    if name == "pagerank":
        assert [r.rank for r in rows] == pytest.approx([states[v] for v in range(graph.n)], abs=1e-8)
        assert abs(done.supersteps - steps) <= 1
    else:
        got = {r.id: (r.distance, r.predecessor) if name in ("bfs", "sssp") else r.label for r in rows}
        assert got == states
        assert done.supersteps == steps
        assert [(x.active_vertices, x.messages_sent) for x in done.logs] == logs
        assert done.max_reached == reached
    return done


@pytest.mark.parametrize(("text", "algorithm", "target", "expected", "steps"), [
    (SIMPLE, BFS, 4, (True, 3, [0, 1, 3, 4]), 3),
    (WEIGHTED, BELLMAN_FORD, 3, (True, 4, [0, 2, 1, 3]), 3),
    (WEIGHTED, BFS, 3, (True, 2, [0, 1, 3]), 2),
    (DISCONNECTED, BFS, 3, (False, None, None), 1),
    (SIMPLE, BFS, 0, (True, 0, [0]), 3),
])
def test_paths(spark, text, algorithm, target, expected, steps):
    done = run(parse_graph(spark, text), algorithm.program, RunConfig(0, target))
    assert tuple(algorithm.result(done).first()) == expected
    assert done.supersteps == steps


def test_components_and_labels(spark):
    done = check(parse_graph(spark, COMPONENTS), "cc")
    assert {r.label: r.members for r in labels.components(done).collect()} == {0: [0, 1, 2, 3], 4: [4, 5, 6, 7], 8: [8, 9, 10, 11]}
    g = parse_graph(spark, COMMUNITIES)
    done = check(g, "lp")
    assert [r.label for r in labels.labels(done).orderBy("id").collect()] == [0, 0, 0, 0, 4, 4, 4, 4]
    assert labels.is_stable(g, labels.labels(done))


def test_direction_counts(spark):
    done = run(parse_graph(spark, "NODES 2\nEDGES\n1 0\n"), CC.program)
    assert [r.label for r in done.states.orderBy("id").collect()] == [0, 1]


def test_silent_vertices_lose_their_vote(spark):
    g = parse_graph(spark, "NODES 4\nEDGES\n0 1\n1 2\n2 3\n1 3\n3 1\n2 1\n")
    done = check(g, "lp")
    assert [r.label for r in labels.labels(done).orderBy("id").collect()] == [0, 1, 0, 1]
    assert not labels.is_stable(g, labels.labels(done))


def test_oscillation_ends_at_the_cap(spark):
    arcs = "0 1,0 4,1 2,1 3,1 5,2 4,2 5,3 4,3 5,4 5".replace(",", "\n")
    done = check(parse_graph(spark, f"NODES 6\nUNDIRECTED\nEDGES\n{arcs}\n"), "lp")
    assert done.max_reached and done.supersteps == 6


def test_cap_that_is_just_reached_is_flagged(spark):
    done = check(parse_graph(spark, SIMPLE), "bfs", 0, 3)
    assert done.max_reached


def test_pagerank(spark):
    done = run(parse_graph(spark, DANGLING), PAGERANK.program, RunConfig(max_steps=20))
    assert [(x.active_vertices, x.messages_sent) for x in done.logs] == [(4, 24)] * 20
    assert sum(r.rank for r in done.states.collect()) == pytest.approx(1, abs=1e-6)
    check(parse_graph(spark, DANGLING), "pagerank", cap=12)
    check(parse_graph(spark, "NODES 3\nEDGES\n0 1\n0 1\n1 2\n2 0\n"), "pagerank", cap=12)


@pytest.mark.parametrize("text", ["NODES 1\nEDGES\n0 0\n"])
def test_single_loop(spark, text):
    g = parse_graph(spark, text)
    for name in MODELS:
        assert run(g, MODELS[name].program, RunConfig(0, 0)).supersteps == 1


def test_predecessor_rules(spark):
    g = parse_graph(spark, "NODES 6\nWEIGHTED\nEDGES\n0 4 1\n4 5 2\n0 1 1\n1 2 1\n2 5 1\n")
    assert check(g, "sssp", 0).states.filter("id = 5").first().predecessor == 4
    g = parse_graph(spark, "NODES 6\nEDGES\n0 5\n5 4\n0 3\n3 4\n")
    assert check(g, "bfs", 0).states.filter("id = 4").first().predecessor == 3


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    """Parallel arcs, loops, isolated vertices, both kinds of direction."""
    rng = random.Random(seed)
    n = rng.randint(3, 8)
    lines = "\n".join(f"{rng.randrange(n)} {rng.randrange(n)} {rng.randint(1, 9)}" for _ in range(rng.randint(n, 2 * n)))
    g = parse_graph(spark, f"NODES {n}\nWEIGHTED\n{'UNDIRECTED' if seed % 2 else ''}\nEDGES\n{lines}\n")
    for name in ("bfs", "sssp", "cc", "lp"):
        check(g, name, 0)
    check(g, "pagerank", cap=8)


def test_all_paths(spark):
    done = run(parse_graph(spark, SIMPLE), BFS.program, RunConfig(0, 0))
    found = {r.id: r.path for r in paths.all_paths(done.states, 0).collect()}
    assert found == {0: [0], 1: [0, 1], 2: [0, 2], 3: [0, 1, 3], 4: [0, 1, 3, 4]}


def test_label_query_runs_to_its_halt(spark, tmp_path):
    """A chain of successions takes a step per vertex, and more than the 6 of the query's SQL."""
    from sparkloom.plans.queries import QUERIES

    n, rng = 14, random.Random(5)
    buyers = [*range(n), *(rng.randrange(n // 2) for _ in range(6))]
    rows = [(i, b, "1995-01-01" if i < n else "1995-01-02", 1000.0 * i) for i, b in enumerate(buyers)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    arcs = [(a[1], b[1], 1) for a, b in zip(rows, rows[1:]) if a[2] == b[2]]
    want, steps, _, reached = model(n, arcs, "lp", None, None)
    assert steps > 6 and not reached and want != model(n, arcs, "lp", None, 6)[0]
    assert {r.id: r.label for r in QUERIES["lp_labels"](spark, str(tmp_path)).collect()} == want


def test_hubs_are_dealt_out(spark, monkeypatch):
    """Arcs of vertices with many of them are salted; results and logs stay as they are."""
    monkeypatch.setattr("sparkloom.operators.superstep.HUB", 2)
    for text in (COMPONENTS, COMMUNITIES, WEIGHTED):
        for name in ("sssp", "cc", "lp"):
            check(parse_graph(spark, text), name, 0)
    check(parse_graph(spark, DANGLING), "pagerank", cap=6)


def test_long_paths(spark):
    n = 40
    g = parse_graph(spark, f"NODES {n + 1}\nEDGES\n" + "".join(f"{i} {i + 1}\n" for i in range(n - 1)))
    done = run(g, BFS.program, RunConfig(0, n - 1))
    assert tuple(paths.path_to(done.states, n - 1).first()) == (True, n - 1, list(range(n)))
    assert tuple(paths.path_to(done.states, n).first()) == (False, None, None)
    assert tuple(paths.path_to(done.states, 0).first()) == (True, 0, [0])
    assert {r.id: r.path for r in paths.all_paths(done.states, 0).collect()} == {i: list(range(i + 1)) for i in range(n)}


def test_old_checkpoints_are_deleted(spark, tmp_path):
    import os

    before = spark.sparkContext.getCheckpointDir()
    root = before.removeprefix("file:")
    seen = set(os.listdir(root))
    done = run(parse_graph(spark, COMPONENTS), CC.program)
    assert done.supersteps == 3 and len(set(os.listdir(root)) - seen) == 1
    assert done.states.count() == 12
