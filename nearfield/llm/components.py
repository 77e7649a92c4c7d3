"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for each node of edges(a, b); root is the smallest node reachable.

    Each round links every node to the smallest neighbour (large star), then to
    the smallest of its smaller neighbours (small star); the rounds grow with
    the logarithm of the graph. Lineage is cut with checkpoint(). Nodes are
    ordered as Spark orders their type; null nodes and loops are ignored.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct().checkpoint()
    total = _sum(e)
    for _ in range(max_rounds):
        # large star: both directions; every larger neighbour of u goes to u's smallest
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # as a table of its own, so that the join below can split the rows of a hub
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).checkpoint()
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every node's smaller neighbours, and itself, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e2 = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct().checkpoint()
        new = _sum(e2)
        e = e2
        if new == total:
            break
        total = new
    else:
        raise RuntimeError(f"components haven't converged in {max_rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _sum(e: DataFrame) -> tuple:
    """Changes as long as a round changes the edges."""
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
