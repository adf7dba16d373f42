import pytest

from fixtures import COMMUNITIES, DISCONNECTED, SIMPLE
from sparkloom.cli import check_threads, execute, explain
from sparkloom.errors import CliError, GraphEngineError
from sparkloom.functions.text import describe_graph, describe_run, show_double
from sparkloom.operators.program import RunConfig
from sparkloom.operators.superstep import run
from sparkloom.plans.registry import BFS, LABEL_PROPAGATION, PAGERANK, resolve
from sparkloom.sources.text_format import parse_graph


@pytest.mark.parametrize(("x", "text"), [(0.25, "0.25"), (0.05, "5.0e-2"), (1.0, "1.0"), (0.1, "0.1"), (1234567.5, "1234567.5"), (1e7, "1.0e7"), (12345678.0, "1.2345678e7"), (0.0, "0.0"), (100.0, "100.0"), (-0.5, "-0.5"), (1e-9, "1.0e-9")])
def test_numbers(x, text):
    assert show_double(x) == text


def test_output(spark, tmp_path):
    path = tmp_path / "g"
    path.write_text(SIMPLE)
    out = execute(["-g", str(path), "-s", "0", "-t", "4", "-a", "bfs", "-v"], spark)
    for part in ("  Nodes:      5\n  Edges:      5\n", "    0 -> 2 1\n", "    4 -> []\n", "Superstep 0: 2 active vertices, 2 messages sent\n    vertex 1 updated: distance 1\n    vertex 2 updated: distance 1\n    vertex 1 -> 3: DistanceMsg {dmFrom = 1, dmDistance = 1}\n", "Converged in 3 supersteps.\n", "Result: path found\n  Distance: 3\n  Path:     [0,1,3,4]\n"):
        assert part in out, part


def test_traces(spark):
    g = parse_graph(spark, "NODES 2\nEDGES\n0 1\n")
    done = run(g, PAGERANK.program, RunConfig(max_steps=1, trace=True))
    out = describe_run(done, PAGERANK, True)
    assert "Superstep 0: 2 active vertices, 7 messages sent" in out
    assert out.count("RankMsg") == 7
    assert "Warning: maximum superstep limit reached." in out
    done = run(parse_graph(spark, COMMUNITIES), LABEL_PROPAGATION.program, RunConfig(trace=True))
    assert [(x.active_vertices, x.messages_sent) for x in done.logs] == [(8, 18)] * 3
    out = describe_run(done, LABEL_PROPAGATION, True)
    assert "LabelMsg {lmLabel = 0}" in out and "updated: label" in out and "  node 7 -> label 4" in out


def test_no_path_and_weights(spark):
    done = run(parse_graph(spark, DISCONNECTED), BFS.program, RunConfig(0, 3))
    assert describe_run(done, BFS).endswith("Result: no path between source and target\n")
    assert "    0 -> 1(4)\n" in describe_graph(parse_graph(spark, "NODES 2\nWEIGHTED\nEDGES\n0 1 4\n"))


@pytest.mark.parametrize(
    ("argv", "message"),
    [
        (["-g", "x", "-a", "DFS"], "unknown algorithm: DFS (use BFS, BELLMANFORD, PAGERANK, CC, LP)"),
        (["-g", "x", "-a", "BFS"], "--target is required to compute a path (BFS and Bellman-Ford)"),
        (["-g", "x", "-a", "sssp", "-t", "1"], "--source is required for path algorithms (BFS and Bellman-Ford)"),
        (["-g", "x", "-a", "cc", "-s", "-1x"], None),
        (["-g", "x", "-a", "cc", "--threads", "0"], "Error: --threads must be at least 1"),
        (["-g", "/nowhere", "-a", "cc"], "Error loading graph: Could not read file /nowhere: /nowhere: openFile: does not exist (No such file or directory)"),
    ],
)
def test_errors(spark, argv, message):
    if message is None:
        with pytest.raises((GraphEngineError, SystemExit)):
            execute(argv, spark)
        return
    with pytest.raises(GraphEngineError) as e:
        execute(argv, spark)
    assert explain(e.value) == message


def test_source_in_range(spark, tmp_path):
    (tmp_path / "g").write_text(SIMPLE)
    with pytest.raises(GraphEngineError) as e:
        execute(["-g", str(tmp_path / "g"), "-a", "cc", "-s", "5"], spark)
    assert explain(e.value) == "Error in source/target: SOURCE 5 out of range [0, 4]"


def test_names_and_threads():
    assert {resolve(x).name for x in ("lp", "LabelPropagation")} == {"LabelPropagation"}
    assert check_threads(None, 3) == 3 and check_threads(2, 3) == 2
    with pytest.raises(CliError):
        check_threads(4, 3)
