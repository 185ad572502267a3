"""Connected components of an edge table, by alternating large-star and small-star rounds. Nothing reaches the
driver but whether a round was the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Rows of a partition of the table between rounds, at most, about.
PART_ROWS = 200_000


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Every node u joins its neighbours to the smallest of them and itself: the larger ones, or (small) the rest."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # dealt out anew, so that the join sees two exchanges and can split a node with very many neighbours
    low = low.repartition(-(-int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    linked = both.join(low, "a")
    if small:  # here b < a always: neighbours b and a itself go to m
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()
    return linked.where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b (longs; any order, repeats allowed). Returns node, component (the smallest node it reaches)."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        now = cut(_star(_star(now, False), True))
        # settled if every node has one neighbour, and no such neighbour has one itself
        ends = now.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        unsettled, rows = nodes.agg(F.count_if(F.expr("up > 1 or up = 1 and down = 1")), F.sum("up")).first()
        now = now.coalesce(1 + (rows or 0) // PART_ROWS)  # fewer, larger partitions for what the rounds have contracted
        release(now.sparkSession)
        if not unsettled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
