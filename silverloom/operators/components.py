"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from silverloom.sources.snapshots import settle


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    Each round points nodes at smaller neighbours of their neighbours; the smallest neighbour comes
    from an aggregate that combines before its shuffle, so a node with very many links is one row a
    task there, and the join that follows is one that Spark splits when it is skewed. The end is
    when every link goes from a node that has no other to one that has none; only the number of nodes
    for which that isn't so comes to the driver. Null ends and loops are no links; repeated links count
    once; without links there are no nodes.
    """
    now = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        ends = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, F.col("a") == F.col("k")).select(F.explode(ends).alias("x")).select("x.a", "x.b")
        now = settle(small.filter("a <> b").distinct(), "small-star")
        ends = now.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if nodes.filter((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
