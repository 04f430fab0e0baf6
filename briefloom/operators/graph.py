"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for each node of an edge, the root being the least node of its component.

    Alternates hooking every node to the least neighbour of its root's star and halving the paths, in tables that
    are written each round; the rounds grow with the logarithm of the longest path.  Degrees are combined on the
    map side, so a node linked to a third of all others is one row a task.
    """
    first = links = stored(edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).filter("x <> y").distinct())
    every = links.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    while True:
        # Large star: all greater neighbours to the least one; small star: all lesser neighbours to the least one.
        both = links.union(links.select(F.col("y"), F.col("x"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select("v", "m").filter("v <> m").distinct()
        down = large.toDF("y", "x")
        m2 = down.groupBy("y").agg(F.min("x").alias("m"))
        small = down.join(m2, "y").select(F.explode(F.array(F.struct(F.col("x").alias("p"), "m"), F.struct(F.col("y").alias("p"), "m"))).alias("s")).select(F.col("s.m").alias("x"), F.col("s.p").alias("y")).filter("x <> y").distinct()
        fresh = stored(small)
        same = fresh.count() == links.count() and fresh.exceptAll(links).isEmpty()
        if links is not first:
            drop(links)
        links = fresh
        if same:
            break
    return every.join(links.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
