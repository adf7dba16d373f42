"""Shortest paths by blocks: the states of the supersteps, in rounds that follow the blocks."""

import random
from datetime import datetime

import pytest

import __spark_entry__
from fixtures import model
from sparkloom.graph import Graph
from sparkloom.plans import blocks
from sparkloom.plans.registry import BELLMAN_FORD, BFS


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def rows(df):
    return {r.id: (r.distance, r.predecessor) for r in df.collect()}


@pytest.mark.parametrize("algorithm,name", [(BFS, "bfs"), (BELLMAN_FORD, "sssp")])
@pytest.mark.parametrize("seed,per_block", [(1, 12), (2, 30), (3, 1000)])
def test_states_are_those_of_the_supersteps(spark, monkeypatch, algorithm, name, seed, per_block):
    """Ties, loops, parallel arcs and vertices that nothing reaches, in several blocks and in one."""
    monkeypatch.setattr(blocks, "ROWS", per_block)
    rng = random.Random(seed)
    arcs = [(rng.randrange(35), rng.randrange(35), rng.randint(1, 4)) for _ in range(70)]
    frame = spark.createDataFrame([(*a, i) for i, a in enumerate(arcs)], "src long, dst long, weight long, pos long")
    found = rows(blocks.distances(Graph.from_edges(frame, 40), algorithm.program, 3))
    assert found == model(40, arcs, name, source=3)[0]


def test_large_blocks_go_by_supersteps(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 2)
    frame = spark.createDataFrame([(0, i, i) for i in range(1, 12)], "src long, dst long, weight long")
    assert rows(blocks.distances(Graph.from_edges(frame, 12), BELLMAN_FORD.program, 0)) == {0: (0, None), **{i: (i, 0) for i in range(1, 12)}}


def test_overflow_raises(spark):
    frame = spark.createDataFrame([(0, 1, (1 << 63) - 1), (1, 2, 1)], "src long, dst long, weight long")
    with pytest.raises(Exception, match="overflow"):
        blocks.distances(Graph.from_edges(frame, 3), BELLMAN_FORD.program, 0)


@pytest.mark.parametrize("name", ["sssp_parallel_arcs", "bfs_distances"])
def test_jobs_follow_the_blocks(spark, tmp_path, monkeypatch, name):
    """A path of sixty arcs through four blocks is no sixty steps."""
    monkeypatch.setattr(blocks, "ROWS", 15)
    spark.range(60).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(i, i, 1000.0 * (i % 7), datetime(2020, 1, 1)) for i in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    before = jobs(spark)
    found = rows(__spark_entry__.queries()[name](spark, str(tmp_path)))
    assert jobs(spark) - before < 60
    far = 0
    for i in range(1, 60):
        assert found[i] == (far, i - 1 if i > 1 else None)
        far += (7 if i % 7 == 6 else 2) if name == "sssp_parallel_arcs" else 1
