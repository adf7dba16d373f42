"""The line-oriented graph format.

``NODES n``, ``WEIGHTED``, ``UNDIRECTED`` and ``EDGES`` are directives; after ``EDGES``
each line is ``from to`` or, once ``WEIGHTED`` was seen, ``from to weight``.  Any other
directive ends the edge list.  Blank lines count for nothing; there are no comments.

The order of lines carries meaning.  Where Spark reads the file, lines are numbered by their
place in blocks, and parsed where they lie; a text or a file of the driver's is parsed by
the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EndpointOutOfRange, LoadError, ParseError
from ..graph import EDGE_COLUMNS, Graph, place, symmetrize
from ..operators.state_log import Folder

_SCHEMA = "src long, dst long, weight long, no long"
_INT = re.compile(r"-?[0-9]{1,19}")
#: Ids, counts and weights are 64-bit; larger numbers are refused like any other text.
MOST = (1 << 63) - 1
#: After every line.
LAST = MOST
#: What str.split() splits at, for Spark.
_SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _integer(token: str, least: int, what: str, need: str, kind: str) -> int:
    value = int(token) if _INT.fullmatch(token) else None
    if value is None or not least <= value <= MOST:
        raise ParseError(f"{what} must be {need}: {token}", kind, what, token)
    return value


def _node(token: str, what: str) -> int:
    return _integer(token, 0, what, "an integer >= 0", "not-a-node")


def _positive(token: str, what: str) -> int:
    return _integer(token, 1, what, "a positive integer", "not-positive")


@dataclass
class _Reader:
    """What the directives read so far say."""

    n: int | None = None
    listing: bool = False
    weighted: bool = False
    undirected: bool = False

    def directive(self, token: list[str]) -> bool:
        """Follow the line if it is a directive."""
        if token[0] == "NODES" and len(token) == 2:
            self.n, self.listing = _positive(token[1], "NODES"), False
        elif token == ["EDGES"]:
            self.listing = True
        elif token == ["WEIGHTED"]:
            self.weighted, self.listing = True, False
        elif token == ["UNDIRECTED"]:
            self.undirected, self.listing = True, False
        else:
            return False
        return True

    def arc(self, line: str, token: list[str]) -> tuple[int, int, int]:
        """The arc of a line that is no directive."""
        if not self.listing:
            raise ParseError(f"Unknown line or outside EDGES section: {line}", "unknown-line", value=line)
        if self.weighted:
            if len(token) != 3:
                raise ParseError("In WEIGHTED mode each edge must have the format: <from> <to> <weight>", "weighted-edge")
            return _node(token[0], "edge (from)"), _node(token[1], "edge (to)"), _positive(token[2], "edge (weight)")
        if len(token) == 3:
            raise ParseError(f"Weighted edge found but WEIGHTED directive is missing: {' '.join(token)}", "weight-without-weighted", value=" ".join(token))
        if len(token) != 2:
            raise ParseError("Each edge must have the format: <from> <to>", "unweighted-edge")
        return _node(token[0], "edge (from)"), _node(token[1], "edge (to)"), 1

    def count(self, arcs: int) -> int:
        """The number of vertices, once all is read."""
        if self.n is None:
            raise ParseError("Missing NODES directive", "missing-nodes", "NODES")
        if not arcs:
            raise ParseError("Missing EDGES section or no edges defined", "no-edges")
        return self.n


def parse_lines(text: str) -> tuple[int, list[tuple[int, int, int]], bool]:
    """(n, arcs in file order, undirected)."""
    reader, arcs = _Reader(), []
    for line in filter(None, (x.strip() for x in text.split("\n"))):
        token = line.split()
        if not reader.directive(token):
            arcs.append(reader.arc(line, token))
    return reader.count(len(arcs)), arcs, reader.undirected


def _check_ends(a: int, b: int, n: int) -> None:
    for end, node in (("from", a), ("to", b)):
        if node >= n:
            raise ParseError(str(EndpointOutOfRange(end, node, n)), "out-of-range", f"edge ({end})", node, n)


def parse_graph(spark: SparkSession, text: str) -> Graph:
    """The graph of a file's text; arcs are listed from the last line to the first."""
    n, arcs, undirected = parse_lines(text)
    last = len(arcs) - 1
    for a, b, _ in reversed(arcs):
        _check_ends(a, b, n)
    edges = spark.createDataFrame([(a, b, w, last - i) for i, (a, b, w) in enumerate(arcs)], _SCHEMA).withColumn("pos", place(F.col("no"))).select(*EDGE_COLUMNS)
    return Graph(spark, n, symmetrize(edges) if undirected else edges)


def graph_text(n: int, arcs: list[tuple[int, ...]], weighted: bool = False, undirected: bool = False) -> str:
    """A file of the format with these arcs (src, dst[, weight]) in this order."""
    head = [f"NODES {n}", *["WEIGHTED"] * weighted, *["UNDIRECTED"] * undirected, "EDGES"]
    return "\n".join([*head, *(" ".join(map(str, a[: 3 if weighted else 2])) for a in arcs)]) + "\n"


def graph_lines(n: int, arcs: DataFrame, weighted: bool = False, undirected: bool = False) -> DataFrame:
    """no, value: the lines of such a file, with the arcs (no, src, dst[, weight]) in the order of no; the head has none."""
    head = "\n".join([f"NODES {n}", *["WEIGHTED"] * weighted, *["UNDIRECTED"] * undirected, "EDGES"])
    first = arcs.sparkSession.createDataFrame([(None, head)], "no long, value string")
    return first.unionByName(arcs.select(F.col("no").cast("long").alias("no"), F.concat_ws(" ", "src", "dst", *["weight"] * weighted).alias("value")))


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """block (file, start), at, line, a, b, w of every line, in a table of its own; a is NULL where the line can be no arc.

    A block lies in one task, where ``at`` rises along its lines.
    """
    number = {}
    for k, name in enumerate("abw"):
        token = F.get("token", F.lit(k))
        number[name] = F.when(token.rlike(r"^-?[0-9]{1,19}\z"), token.try_cast("long"))
    found = spark.read.option("lineSep", "\n").text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
        F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", rf"\A{_SPACES}|{_SPACES}\z", "").alias("line"))
    found = found.withColumn("token", F.split("line", _SPACES)).select("*", *(c.alias(k) for k, c in number.items()), F.size("token").alias("size"))
    arc = F.col("size").isin(2, 3) & (F.col("a") >= 0) & (F.col("b") >= 0) & ((F.col("size") == 2) | (F.coalesce("w", F.lit(0)) >= 1))
    return Folder(spark).kept(found.select("block", "at", "line", F.when(arc, F.col("a")).alias("a"), "b", "w"), "lines")


def _read_graph(spark: SparkSession, path: str) -> Graph:
    """The graph of a file, or of a folder's files in the order of their names.  Only directives come to the driver."""
    lines = _parsed(spark, path)
    blocks = sorted((r.block.file, r.block.start) for r in lines.select("block").distinct().collect())
    if not blocks:
        raise LoadError(path, f"{path}: nothing to read")
    ranks = spark.createDataFrame([(b, i) for i, b in enumerate(blocks)], "block struct<file: string, start: bigint>, rank long")
    # lines of the whole file in order, with gaps; a task's lines are the lower 33 bits of at
    no = F.shiftleft("rank", 33) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    lines = lines.join(F.broadcast(ranks), "block").filter("line <> ''").select(no.alias("no"), "line", "a", "b", "w")
    directive = F.col("a").isNull() & F.col("line").rlike(rf"\A(NODES{_SPACES}\S+|EDGES|WEIGHTED|UNDIRECTED)\z")
    told = lines.filter(directive).select("no", "line").orderBy("no").collect()

    reader, silent, since, weighted_from, wrong = _Reader(), [], -1, LAST, None
    for r in told:
        was = reader.listing
        try:
            if not reader.directive(r.line.split()):
                continue
        except ParseError as e:
            wrong = (r.no, e)
            break
        if reader.weighted:
            weighted_from = min(weighted_from, r.no)
        if reader.listing and not was:
            silent.append((since, r.no))
        elif was and not reader.listing:
            since = r.no
    if not reader.listing:
        silent.append((since, LAST))
    arcs = lines.filter("a IS NOT NULL")
    outside = arcs.join(F.broadcast(spark.createDataFrame(silent, "since long, until long")), F.col("no").between(F.col("since"), F.col("until")), "left_semi") if silent else arcs.limit(0)
    size = (F.col("no") > weighted_from) != F.col("w").isNotNull()
    far = F.lit(False) if reader.n is None else (F.col("a") >= reader.n) | (F.col("b") >= reader.n)
    seen = arcs.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(size, F.col("no"))).alias("size"), F.max(F.when(far, F.struct("no", "a", "b"))).alias("far")).first()
    fault = lines.filter(F.col("a").isNull() & ~directive).agg(F.min("no").alias("no")).unionByName(outside.agg(F.min("no").alias("no"))).agg(F.min("no")).first()[0]
    fault = min((x for x in (fault, seen["size"]) if x is not None), default=LAST)
    if wrong and wrong[0] < fault:
        raise wrong[1]
    if fault < LAST:
        reader, line = _Reader(), lines.filter(F.col("no") == fault).first().line
        for r in told:
            if r.no < fault:
                reader.directive(r.line.split())
        reader.arc(line, line.split())
        raise ParseError(f"Unknown line or outside EDGES section: {line}", "unknown-line", value=line)
    n = reader.count(seen["n"])
    if seen["far"] is not None:
        _check_ends(seen["far"].a, seen["far"].b, n)
    edges = arcs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.coalesce("w", F.lit(1)).cast("long").alias("weight"), place(-F.col("no")))
    return Graph(spark, n, symmetrize(edges) if reader.undirected else edges)


def load_graph(spark: SparkSession, path: str) -> Graph:
    """Read and parse a file: a local path, or anything with a scheme that Spark reads."""
    try:
        if "://" in path:
            return _read_graph(spark, path)
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        raise LoadError(path, f"{path}: openFile: does not exist (No such file or directory)") from None
    except OSError as e:
        raise LoadError(path, f"{path}: openFile: {e.strerror}") from None
    except UnicodeDecodeError as e:
        raise LoadError(path, f"{path}: {e.reason}") from None
    except (AnalysisException, Py4JJavaError) as e:
        raise LoadError(path, f"{path}: {str(e).splitlines()[0]}") from None
    return parse_graph(spark, text)
