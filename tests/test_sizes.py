"""Work of a task that is bounded, whatever the input's size."""

import random

from fixtures import model
from sparkloom.graph import Graph, symmetrize
from sparkloom.operators import state_log, superstep
from sparkloom.operators.program import RunConfig
from sparkloom.operators.superstep import run
from sparkloom.plans.labels import majority
from sparkloom.plans.registry import BELLMAN_FORD, LABEL_PROPAGATION
from sparkloom.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, folder, n):
    spark.range(10).withColumnRenamed("id", "s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    spark.range(20).withColumnRenamed("id", "p_partkey").write.parquet(f"{folder}/part.parquet")
    spark.range(n).selectExpr("id % 10 AS l_suppkey", "id % 17 AS l_partkey", "CAST(id % 7 + 1 AS double) AS l_quantity").write.parquet(f"{folder}/lineitem.parquet")


def test_trade_is_grouped_once_in_parts_that_follow_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state_log, "ROWS", 50)
    lines(spark, tmp_path, 1000)
    dealt, kept = [], state_log.Folder.kept
    monkeypatch.setattr(state_log.Folder, "kept", lambda self, df, name: (dealt.append(df.rdd.getNumPartitions()), kept(self, df, name))[1])
    edges = tables.trade(spark, str(tmp_path)).edges
    assert dealt == [20] and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert "Exchange" not in plan(edges) and edges.count() == 2 * 170
    least = {}
    for i in range(1000):
        a, b, w = i % 10, i % 17 + 10, i % 7 + 1
        least[a, b] = min(w, least.get((a, b), w))
    assert {(r.src, r.dst, r.weight) for r in edges.collect()} == {x for (a, b), w in least.items() for x in ((a, b, w), (b, a, w))}


def test_symmetrize_groups_numbers_only(spark):
    """Each arc is shuffled once and nothing is sorted; places are those of the list and its reverses."""
    rng = random.Random(3)
    arcs = [(rng.randrange(5), rng.randrange(5), rng.randint(1, 2), i) for i in range(60)]
    frame = spark.createDataFrame(arcs, "src long, dst long, weight long, pos long")
    edges = Graph.from_edges(frame, 5, undirected=True).edges
    assert "SortAggregate" not in plan(edges) and plan(edges).count("Exchange") == 1
    first = {}
    for half in (0, 1):
        for a, b, w, i in arcs:
            if half == 0 or a != b:
                first.setdefault((b, a, w) if half else (a, b, w), (half, i))
    assert {((r.src, r.dst, r.weight), tuple(r.pos)) for r in edges.collect()} == set(first.items())
    unlisted = symmetrize(Graph.from_edges(frame.drop("pos"), 5).edges, listed=False)
    assert {((r.src, r.dst, r.weight), tuple(r.pos)) for r in unlisted.collect()} == {(k, (0, ~k[2])) for k in first}


def test_majority_counts_numbers_and_sorts_nothing(spark):
    rng = random.Random(4)
    own = {i: rng.randrange(6) for i in range(12)}
    votes = [(rng.randrange(12), rng.randrange(10), rng.randrange(6)) for _ in range(70)]
    states = spark.createDataFrame(list(own.items()), "id long, label long")
    frame = spark.createDataFrame(votes, "src long, dst long, label long")
    want = {}
    for v in {d for _, d, _ in votes}:
        all_votes = [x for _, d, x in votes if d == v] + [own[v]]
        want[v] = max((all_votes.count(x), -x) for x in all_votes)
    for most, sorts in ((70, False), ((1 << 63) - 2, True)):
        best = majority(frame, states, 12, most)
        assert {r.dst: tuple(r.best) for r in best.collect()} == want
        assert ("SortAggregate" in plan(best)) == sorts and "Join" not in plan(best)


def test_parts_of_a_run_follow_its_arcs(spark, monkeypatch):
    monkeypatch.setattr(state_log, "ROWS", 20)
    arcs = [(i, (i * 7 + 1) % 50, i % 5 + 1) for i in range(50)] * 4
    g = Graph.from_edges(spark.createDataFrame(arcs, "src long, dst long, weight long"), 50)
    done = run(g, LABEL_PROPAGATION.program, RunConfig(max_steps=2))
    assert done.states.rdd.getNumPartitions() == 10
    assert {r.id: r.label for r in done.states.collect()} == model(50, arcs, "lp", cap=2)[0]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_effective_weights_of_arcs_need_no_join(spark):
    """Parallel arcs all get the last one's weight; simple graphs are only read."""
    rng = random.Random(6)
    arcs = [(rng.randrange(5), rng.randrange(5), rng.randint(1, 9), i) for i in range(60)]
    g = Graph.from_edges(spark.createDataFrame(arcs, "src long, dst long, weight long, pos long"), 5)
    last = {(a, b): w for a, b, w, _ in arcs}
    found = BELLMAN_FORD.program.edges(g)
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, b, last[a, b]) for a, b, _, _ in arcs)
    assert "Join" not in plan(found) and "SortAggregate" not in plan(found)
    simple = Graph.from_edges(spark.range(4).selectExpr("id AS src", "id + 1 AS dst", "id + 1 AS weight"), 5, undirected=True, simple=True)
    assert "Exchange" not in plan(BELLMAN_FORD.program.edges(simple)) and BELLMAN_FORD.program.edges(simple).count() == 8


def test_blocks_of_arcs_follow_the_arcs(spark, monkeypatch):
    """Two hundred vertices of fifty arcs each: a step that one vertex speaks in doesn't read the arcs of a hundred."""
    monkeypatch.setattr(state_log, "BLOCK", 100)
    monkeypatch.setattr(superstep, "LEAST", 0)
    monkeypatch.setattr(superstep, "SPARSE", 1)
    largest = []

    class Seen(state_log.BlockArcs):
        def __init__(self, *args):
            super().__init__(*args)
            largest.append(max(r["count"] for r in self.arcs.groupBy("_block").count().collect()))

    monkeypatch.setattr(superstep, "BlockArcs", Seen)
    arcs = spark.range(200 * 50).selectExpr("id div 50 AS src", "(id div 50 + 1 + id % 50) % 200 AS dst", "1 + id % 50 AS weight")
    done = run(Graph.from_edges(arcs, 200), BELLMAN_FORD.program, RunConfig(source=0))
    assert largest == [100]
    assert {r.id: r.distance for r in done.states.collect()} == {i: i for i in range(200)}
