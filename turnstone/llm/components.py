"""Connected components by alternating large-star and small-star, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over distinct edges (a, b) with a > b.

    Each node learns the smallest id among itself and its neighbours. Large-star hangs the larger neighbours on it,
    small-star the node and its smaller ones. Minima are pre-aggregated; no neighbour list is ever gathered.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(low, "a")
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
    return hung.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, any order, loops and repeats allowed -> (node, component): the smallest reachable id.

    Nodes without an edge to another node don't come out. Every step is cut with checkpoint(); the loop ends when a
    pair of steps leaves the edges as they are, after about log(longest path) rounds.
    """
    now = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    state = None
    while True:
        seen = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = seen
        now = _star(_star(now, True), False).checkpoint()
