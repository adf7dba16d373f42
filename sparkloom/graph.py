"""The graph: dense vertex ids 0..n-1 and a table of weighted arcs.

``edges`` has src, dst, weight (> 0) and pos, the arc's place in the graph's list of arcs:
a struct (half, no), where half is 1 for the reverses that make a graph undirected.  Row
order means nothing in Spark, so everything that depends on the list's order goes by pos,
which is compared and never computed with.  Parallel arcs and loops are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EndpointOutOfRange, InvalidNodeCount, InvalidWeight, RunNodeOutOfRange

EDGE_COLUMNS = ("src", "dst", "weight", "pos")


def place(no: Column, half: int = 0) -> Column:
    """The column pos of an arc with this number."""
    return F.struct(F.lit(half).alias("half"), no.alias("no")).alias("pos")


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    n: int
    edges: DataFrame
    simple: bool = False  # known to have no parallel arcs
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def from_edges(cls, edges: DataFrame, n: int, undirected: bool = False, simple: bool = False) -> Graph:
        """A validated graph from src, dst and, optionally, weight (else 1) and pos.

        ``simple`` says that no two rows have the same ends, whichever way, and none is a loop:
        then nothing has to be grouped.

        Without pos, arcs have no order: among parallel arcs, whichever way they were given,
        the lightest counts for shortest paths.  One scan checks ids and weights.
        """
        spark = edges.sparkSession
        if n <= 0:
            raise InvalidNodeCount(n)
        weight = F.col("weight").cast("long") if "weight" in edges.columns else F.lit(1).cast("long")
        listed = "pos" in edges.columns
        pos = F.col("pos").cast("long") if listed else F.bitwise_not(weight)  # falls as the weight rises; the negative may overflow
        e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"), place(pos))
        check_edges(e, n)
        if not undirected:
            return cls(spark, n, e, simple)
        return cls(spark, n, both_ways(e, listed) if simple else symmetrize(e, listed), simple)

    def vertices(self) -> DataFrame:
        return self.spark.range(self.n)

    def neighbors(self, node: int) -> DataFrame:
        """dst, weight of the arcs out of ``node``, in list order."""
        return self.edges.filter(F.col("src") == node).orderBy("pos").select("dst", "weight")

    def out_degrees(self) -> DataFrame:
        """id, degree (parallel arcs count) of every vertex."""
        degree = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices().join(degree, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def effective_weights(self) -> DataFrame:
        """src, dst, weight: of parallel arcs, the weight of the last in list order."""
        if self.simple:
            return self.edges.select("src", "dst", "weight")
        return self.edges.groupBy("src", "dst").agg(_last_weight().alias("weight"))

    def arcs_of_effective_weight(self) -> DataFrame:
        """src, dst, weight of all arcs, each with its effective weight."""
        if self.simple:
            return self.edges.select("src", "dst", "weight")
        grouped = self.edges.groupBy("src", "dst").agg(_last_weight().alias("weight"), F.count(F.lit(1)).cast("int").alias("_n"))
        return grouped.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")

    def adjacency(self) -> DataFrame:
        """id, neighbors (array of dst, weight in list order) of every vertex."""
        lists = self.edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", "dst", "weight"))).alias("arcs"))
        arcs = F.transform("arcs", lambda a: F.struct(a["dst"].alias("dst"), a["weight"].alias("weight")))
        none = F.array().cast("array<struct<dst:bigint,weight:bigint>>")
        return self.vertices().join(lists, F.col("id") == F.col("src"), "left").select("id", F.coalesce(arcs, none).alias("neighbors"))

    def adjacency_pages(self, size: int = 10_000) -> DataFrame:
        """id, page_no, neighbors (dst, weight) of vertices with arcs: lists of any length in rows of at most ``size``.

        Pages in order of page_no, whose numbers have gaps, make up the list.  Arcs are dealt out
        by ranges of (src, pos), so a vertex with many of them fills many tasks.
        """
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = self.edges.repartitionByRange(parts, "src", "pos").sortWithinPartitions("src", "pos")
        # the upper bits are the partition's number, the lower ones the place in it
        at = ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("page_no", F.floor(F.col("_at") / size).cast("long"))
        lists = at.groupBy("src", "page_no").agg(F.sort_array(F.collect_list(F.struct("_at", "dst", "weight"))).alias("arcs"))
        return lists.select(F.col("src").alias("id"), "page_no", F.transform("arcs", lambda a: F.struct(a["dst"].alias("dst"), a["weight"].alias("weight"))).alias("neighbors"))

    def arc_count(self) -> int:
        if "arcs" not in self._memo:
            self._memo["arcs"] = self.edges.count()
        return self._memo["arcs"]

    def check_run_nodes(self, source: int | None, target: int | None) -> None:
        for role, node in (("SOURCE", source), ("TARGET", target)):
            if node is not None and not 0 <= node < self.n:
                raise RunNodeOutOfRange(role, node, self.n)


def invalid_edges(edges: DataFrame, n: int) -> DataFrame:
    """Arcs with an end outside 0..n-1 or a weight that isn't positive, with the end at fault first found."""

    def bad(c: str):
        return F.col(c).isNull() | ~F.col(c).between(0, n - 1)

    fault = F.when(bad("src"), "from").when(bad("dst"), "to").when(F.col("weight").isNull() | (F.col("weight") <= 0), "weight")
    return edges.withColumn("fault", fault).filter("fault IS NOT NULL")


def check_edges(edges: DataFrame, n: int) -> None:
    """Raise for the first invalid arc in list order; ends before weights."""
    first = invalid_edges(edges, n).orderBy(F.col("fault") == "weight", "pos").limit(1).collect()
    for e in first:
        if e.fault == "weight":
            raise InvalidWeight(e.weight)
        raise EndpointOutOfRange(e.fault, e.src if e.fault == "from" else e.dst, n)


def _last_weight() -> Column:
    """Of parallel arcs, the weight of the last in list order; numbers only, so that no rows are sorted."""
    reverse, given = (F.expr(f"max_by(weight, pos.no) FILTER (WHERE pos.half = {half})") for half in (1, 0))
    return F.coalesce(reverse, given)


def both_ways(edges: DataFrame, listed: bool = True) -> DataFrame:
    """Arcs and their reverses, where no two arcs join the same ends and none is a loop."""
    turned = (F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), place(F.col("pos.no"), 1 if listed and a == "dst" else 0)) for a, b in (("src", "dst"), ("dst", "src")))
    return edges.select("weight", F.explode(F.array(*turned)).alias("arc")).select("arc.src", "arc.dst", "weight", "arc.pos")


def symmetrize(edges: DataFrame, listed: bool = True) -> DataFrame:
    """Arcs and their reverses, one of each (src, dst, weight), at its first place.

    Reverses come after all arcs, in the same order (half 1); loops have none.  If arcs aren't
    ``listed``, their place only ranks weights, so reverses go among the arcs (half 0).

    Arcs of either way are grouped by their two ends, each row once, and turned afterwards.
    """
    up = F.col("src") <= F.col("dst")
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight"]
    places = edges.select(*ends, F.when(up, F.col("pos.no")).alias("up"), F.when(~up, F.col("pos.no")).alias("down")).groupBy("src", "dst", "weight").agg(F.min("up").alias("up"), F.min("down").alias("down"))

    def arc(src: str, dst: str, given: str, other: str) -> Column:
        half = F.when(F.col(given).isNull(), 1).otherwise(0) if listed else F.lit(0)
        no = F.coalesce(given, other) if listed else F.least(given, other)
        return F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.struct(half.alias("half"), no.alias("no")).alias("pos"))

    there, back = arc("src", "dst", "up", "down"), arc("dst", "src", "down", "up")
    turned = F.explode(F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back)))
    return places.select("weight", turned.alias("arc")).select("arc.src", "arc.dst", "weight", "arc.pos")
