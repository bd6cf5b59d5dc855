"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.common import stored
from ticketscope.operators.joins import hot_keys, spread_join


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that is not the smallest of its component.

    Alternates two steps until nothing changes: all larger neighbours of a node are hung on its
    smallest neighbour, then all smaller ones. Minima are merged before they are shuffled, so a
    node with very many edges sends one row per task, and where its edges meet its minimum they are
    dealt to many tasks. Every round is written to the shared folder.
    """
    links = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    links = stored(links.filter("node != root").distinct())
    state = None
    while True:
        found = links.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("node", "root").cast("decimal(20,0)")).alias("sum"),
        ).first()
        if found.n == 0 or tuple(found) == state:
            return links
        state = tuple(found)
        both = links.select(F.col("node").alias("x"), F.col("root").alias("y")).union(
            links.select(F.col("root").alias("x"), F.col("node").alias("y"))
        )
        count = F.count(F.lit(1)).alias("n")
        upward = both.filter("y > x")
        low = both.groupBy("x").agg(F.min("y").alias("m"), F.count_if(F.col("y") > F.col("x")).alias("n"))
        hubs = hot_keys(low, "x", found.n)
        large = (
            spread_join(upward, low.drop("n"), "x", "inner", hubs)
            .select(F.col("y").alias("node"), F.least("m", "x").alias("root")).distinct()
        )
        lowest = large.groupBy("node").agg(F.min("root").alias("m"), count)
        leaves = hot_keys(lowest, "node", found.n)
        small = (
            spread_join(large, lowest.drop("n"), "node", "inner", leaves).filter("root != m")
            .select(F.col("root").alias("node"), F.col("m").alias("root"))
        )
        links = stored(small.union(lowest.select("node", F.col("m").alias("root"))).distinct())
