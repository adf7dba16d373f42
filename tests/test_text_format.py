import pytest

from fixtures import COMPONENTS, SIMPLE
from sparkloom.errors import EndpointOutOfRange, InvalidNodeCount, InvalidWeight, LoadError, ParseError, RunNodeOutOfRange
from sparkloom.graph import Graph
from sparkloom.sources.text_format import graph_text, load_graph, parse_graph, parse_lines


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("EDGES\n0 1\n", "Missing NODES directive"),
        ("NODES 2\n", "Missing EDGES section or no edges defined"),
        ("NODES 2\nEDGES\n", "Missing EDGES section or no edges defined"),
        ("NODES 0\nEDGES\n0 1\n", "NODES must be a positive integer: 0"),
        ("NODES x\nEDGES\n0 1\n", "NODES must be a positive integer: x"),
        ("NODES 2\n0 1\n", "Unknown line or outside EDGES section: 0 1"),
        ("NODES 2\n# note\nEDGES\n0 1\n", "Unknown line or outside EDGES section: # note"),
        ("NODES 2\nEDGES\n0 1 5\n", "Weighted edge found but WEIGHTED directive is missing: 0 1 5"),
        ("NODES 2\nEDGES\n0\n", "Each edge must have the format: <from> <to>"),
        ("NODES 2\nWEIGHTED\nEDGES\n0 1\n", "In WEIGHTED mode each edge must have the format: <from> <to> <weight>"),
        ("NODES 2\nWEIGHTED\nEDGES\n0 1 0\n", "edge (weight) must be a positive integer: 0"),
        ("NODES 2\nEDGES\n-1 1\n", "edge (from) must be an integer >= 0: -1"),
        ("NODES 2\nEDGES\n0 y\n", "edge (to) must be an integer >= 0: y"),
        ("NODES 2\nEDGES\n0 1\nUNDIRECTED\n1 0\n", "Unknown line or outside EDGES section: 1 0"),
    ],
)
def test_rejects(text, message):
    with pytest.raises(ParseError) as e:
        parse_lines(text)
    assert str(e.value) == message


def test_range_errors_go_from_the_last_line(spark):
    with pytest.raises(ParseError, match=r"edge \(to\) 7 out of range \[0, 1\]"):
        parse_graph(spark, "NODES 2\nEDGES\n9 0\n0 7\n")
    with pytest.raises(ParseError, match=r"edge \(from\) 8 out of range \[0, 1\]"):
        parse_graph(spark, "NODES 2\nEDGES\n0 1\n8 9\n")


def test_directives_anywhere():
    assert parse_lines("EDGES\r\n0 1\r\n\r\nWEIGHTED\r\nEDGES\r\n1 0 3\r\nNODES 9\nNODES 2\n") == (2, [(0, 1, 1), (1, 0, 3)], False)


def test_list_order_is_reverse_file_order(spark):
    g = parse_graph(spark, SIMPLE)
    assert [r.dst for r in g.neighbors(0).collect()] == [2, 1]
    assert (g.n, g.arc_count()) == (5, 5)


def test_undirected(spark):
    g = parse_graph(spark, "NODES 3\nUNDIRECTED\nEDGES\n0 1\n1 0\n0 1\n2 2\n")
    assert [(r.src, r.dst) for r in g.edges.orderBy("pos").collect()] == [(2, 2), (0, 1), (1, 0)]
    assert parse_graph(spark, COMPONENTS).arc_count() == 22


def test_parallel_weights(spark):
    g = parse_graph(spark, "NODES 2\nWEIGHTED\nEDGES\n0 1 4\n0 1 1\n")
    assert g.effective_weights().first().weight == 4
    g = parse_graph(spark, "NODES 2\nWEIGHTED\nUNDIRECTED\nEDGES\n0 1 5\n1 0 3\n")
    assert {(r.src, r.dst): r.weight for r in g.effective_weights().collect()} == {(0, 1): 3, (1, 0): 5}


@pytest.mark.parametrize(("text", "kind", "context", "value"), [
    ("EDGES\n0 1\n", "missing-nodes", "NODES", None),
    ("NODES 2\n", "no-edges", None, None),
    ("NODES 99999999999999999999\nEDGES\n0 1\n", "not-positive", "NODES", "99999999999999999999"),
    ("NODES 2\nWEIGHTED\nEDGES\n0 1 9223372036854775808\n", "not-positive", "edge (weight)", "9223372036854775808"),
    ("NODES 2\nEDGES\n0 -1\n", "not-a-node", "edge (to)", "-1"),
    ("NODES 2\nEDGES\n0 7\n", "out-of-range", "edge (to)", 7),
    ("NODES 2\nEDGES\n0 1 5\n", "weight-without-weighted", None, "0 1 5"),
    ("NODES 2\nx\n", "unknown-line", None, "x"),
    ("NODES 2\nEDGES\n0\n", "unweighted-edge", None, None),
    ("NODES 2\nWEIGHTED\nEDGES\n0 1\n", "weighted-edge", None, None),
])
def test_errors_carry_their_fields(spark, text, kind, context, value):
    with pytest.raises(ParseError) as e:
        parse_graph(spark, text)
    assert (e.value.kind, e.value.context, e.value.value) == (kind, context, value)
    assert kind in ParseError.KINDS and e.value.n == (2 if kind == "out-of-range" else None)


def test_remote_files(spark, tmp_path):
    with pytest.raises(LoadError, match="Could not read file"):
        load_graph(spark, f"file://{tmp_path}/nowhere")
    (tmp_path / "empty").write_text("")
    with pytest.raises((LoadError, ParseError)):
        load_graph(spark, f"file://{tmp_path}/empty")


def test_written_graphs_are_read_back(spark):
    arcs = [(0, 1, 4), (2, 0, 1), (0, 1, 2)]
    assert parse_lines(graph_text(3, arcs, weighted=True)) == (3, arcs, False)
    assert parse_lines(graph_text(3, arcs, undirected=True)) == (3, [(a, b, 1) for a, b, _ in arcs], True)


def test_files(spark, tmp_path):
    with pytest.raises(LoadError, match="Could not read file .*nowhere"):
        load_graph(spark, str(tmp_path / "nowhere"))
    (tmp_path / "bad").write_bytes(b"NODES \xff\n")
    with pytest.raises(LoadError):
        load_graph(spark, str(tmp_path / "bad"))
    (tmp_path / "good").write_text(SIMPLE)
    assert load_graph(spark, str(tmp_path / "good")).n == 5
    assert load_graph(spark, f"file://{tmp_path}/good").n == 5


def test_tables(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src int, dst int")
    assert Graph.from_edges(edges, 3).arc_count() == 2
    with pytest.raises(InvalidNodeCount):
        Graph.from_edges(edges, 0)
    with pytest.raises(EndpointOutOfRange, match=r"edge \(to\) 2 out of range \[0, 1\]"):
        Graph.from_edges(edges, 2)
    with pytest.raises(EndpointOutOfRange):
        Graph.from_edges(spark.createDataFrame([(None, 1)], "src int, dst int"), 2)
    with pytest.raises(InvalidWeight):
        Graph.from_edges(spark.createDataFrame([(0, 1, 0)], "src int, dst int, weight int"), 2)
    g = Graph.from_edges(edges, 4)
    assert [tuple(r) for r in g.out_degrees().orderBy("id").collect()] == [(0, 1), (1, 1), (2, 0), (3, 0)]
    for role, source, target in (("SOURCE", 4, None), ("TARGET", 0, 9), ("SOURCE", -1, 9)):
        with pytest.raises(RunNodeOutOfRange, match=role):
            g.check_run_nodes(source, target)


BLOCKY = "NODES 9\n\nWEIGHTED\nEDGES\n" + "".join(f"{i % 7}\t {i % 5} \x0b {i + 1} \r\n" for i in range(40)) + "UNDIRECTED\nEDGES\n8 8 3\n"


def read(spark, folder, text):
    file = folder / "graph.txt"
    file.write_bytes(text.encode())
    return load_graph(spark, f"file://{file}")


def test_files_are_read_in_blocks(spark, tmp_path, monkeypatch):
    """Lines of a file that Spark reads are parsed where they lie: arcs, order and weights are the driver's."""
    want = parse_graph(spark, BLOCKY)
    monkeypatch.setattr("sparkloom.sources.text_format.parse_lines", None)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        g = read(spark, tmp_path, BLOCKY)
        assert g.n == want.n == 9
        assert [tuple(r) for r in g.edges.orderBy("pos").select("src", "dst", "weight").collect()] == [tuple(r) for r in want.edges.orderBy("pos").select("src", "dst", "weight").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    "text",
    [
        "EDGES\n0 1\n",
        "NODES 2\nEDGES\n",
        "NODES 0\n0 1\n",
        "0 1\nNODES 0\n",
        "NODES 2\n# note  here\nEDGES\n0 1\n",
        "NODES 2\nEDGES\n0 1\nUNDIRECTED\n1  0\nEDGES\n",
        "NODES 2\nEDGES\n0 1\n0 1 5\nWEIGHTED\nEDGES\n",
        "NODES 2\nWEIGHTED\nEDGES\n0 1 3\n0 1\n0 1 0\n",
        "NODES 2\nWEIGHTED\nEDGES\n0 1 9223372036854775808\n",
        "NODES 2\nEDGES\n-1 1\n0 y\n",
        "NODES 2\nEDGES\n9 0\n0 7\n0 1\n",
        "\n \n",
    ],
)
def test_files_in_blocks_have_the_same_faults(spark, tmp_path, text):
    with pytest.raises(ParseError) as want:
        parse_graph(spark, text)
    with pytest.raises(ParseError) as got:
        read(spark, tmp_path, text)
    assert str(got.value) == str(want.value)


def test_text_queries_bring_no_lines_to_the_driver(spark, tmp_path, monkeypatch):
    from sparkloom.plans.queries import QUERIES

    monkeypatch.setattr("sparkloom.sources.text_format.parse_lines", None)
    spark.range(200).selectExpr("id * 3 AS o_orderkey", "id % 11 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    rows = QUERIES["text_weighted_arcs"](spark, str(tmp_path)).orderBy("list_no").collect()
    assert [tuple(r) for r in rows] == [(199 - i, i % 11, i % 11 % 97, i * 3 % 1000 + 1) for i in reversed(range(200))]
