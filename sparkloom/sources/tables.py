"""Graphs derived from whole relational tables.

Ids stay the tables' keys, so nothing has to be ranked globally; kinds of vertices get
ranges of their own.  Keys that occur nowhere are vertices without arcs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.state_log import Folder, dealt


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _top(df: DataFrame, column: str) -> int:
    """One more than the largest key."""
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def places(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected: regions, their nations, and the nations' customers."""
    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    r = _top(_table(spark, sf_dir, "region"), "r_regionkey")
    n = _top(nation, "n_nationkey")
    c = _top(customer, "c_custkey")
    up = nation.select((F.col("n_nationkey") + r).alias("src"), F.col("n_regionkey").alias("dst"))
    down = customer.select((F.col("c_custkey") + r + n).alias("src"), (F.col("c_nationkey") + r).alias("dst"))
    return Graph.from_edges(up.unionByName(down), r + n + c, undirected=True)


def successions(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed, with parallel arcs: a customer, and the next one to order on the same day.

    weight is the difference of the two prices in thousands, plus 1; pos the order's key.
    """
    orders = _table(spark, sf_dir, "orders")
    day = Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")
    weight = F.floor(F.abs(F.lead("o_totalprice").over(day) - F.col("o_totalprice")) / 1000) + 1
    arcs = orders.select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(day).alias("dst"), weight.alias("weight"), F.col("o_orderkey").alias("pos"))
    with dealt(spark, orders.count()):
        arcs = Folder(spark).kept(arcs.filter("dst IS NOT NULL"), "successions")
    return Graph.from_edges(arcs, _top(_table(spark, sf_dir, "customer"), "c_custkey"))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected and weighted: suppliers and the parts that they ship, by the least quantity of a line."""
    items = _table(spark, sf_dir, "lineitem")
    s = _top(_table(spark, sf_dir, "supplier"), "s_suppkey")
    p = _top(_table(spark, sf_dir, "part"), "p_partkey")
    lines = items.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + s).alias("dst"), "l_quantity")
    with dealt(spark, items.count()) as parts:
        # hardly a pair repeats, so grouping before the shuffle would only fill memory
        arcs = Folder(spark).kept(lines.repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.min("l_quantity").cast("long").alias("weight")), "trade")
    return Graph.from_edges(arcs, s + p, undirected=True, simple=True)


def shipments(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected and unlisted: an arc per line, from the supplier or from the part by the line's number, weighted by quantity."""
    s = _top(_table(spark, sf_dir, "supplier"), "s_suppkey")
    p = _top(_table(spark, sf_dir, "part"), "p_partkey")
    ends = [F.col("l_suppkey"), F.col("l_partkey") + s]
    odd = F.col("l_linenumber") % 2 == 1
    arcs = _table(spark, sf_dir, "lineitem").select(*(F.when(odd, a).otherwise(b).alias(k) for k, a, b in (("src", *ends), ("dst", *ends[::-1]))), F.col("l_quantity").cast("long").alias("weight"))
    return Graph.from_edges(arcs, s + p, undirected=True)
