"""Connected components of a link table by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each round is
two aggregations with joins on the node; a round's links are stored in the shared
folder, so a lost executor costs one round at most.  The number of rounds grows with
the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v.  Large: greater neighbours move to the least; small: lesser ones and the node."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node that has a link; root is the least node (as a signed long) of its component."""
    now = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("sum(CAST(xxhash64(u, v) AS DECIMAL(20, 0)))")).first())

    seen = mark(now)
    while seen[0]:
        now = stored(_star(stored(_star(now, True), "links"), False), "links")
        if (new := mark(now)) == seen:
            break
        seen = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
