"""Connected components of an edge table, by hook-and-shortcut rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.llm._store import discard, kept


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that links reach.

    Alternates large-star and small-star steps, which keep the number of edges
    linear and need a number of rounds about the logarithm of the longest path.
    Each round ends in a written table.  Raises if it has not settled after most_rounds.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before = last = None
    for _ in range(most_rounds):
        # Large star: each larger neighbour of u is hung on the smallest of u and its neighbours.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its smaller neighbours are hung on the smallest of them.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = kept(edges, "components")
        if last is not None:
            discard(last)
        last = edges
        now = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            named = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            named.kept_at = edges.kept_at
            return named
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
