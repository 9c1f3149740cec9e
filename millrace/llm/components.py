"""Connected components by alternating large-star and small-star steps, as plain joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its least neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them. Edges are (larger a, smaller b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b), in any order and number, of any orderable type to (node, component), component the least node reachable, for all
    nodes with an edge to another. A null end makes no edge. Each round is written to the shared folder in place of the one before; only a count
    and a hash of the edges come to the driver. A node of any degree costs partial minima and a join that Spark can split."""
    edges = edges.where("a is not null and b is not null and a != b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))")).first())
    before = sign(edges)
    for _ in range(most_rounds if before[0] else 0):
        grown = _large_star(edges).where("a != b").distinct()
        old, edges = edges, materialise(_small_star(grown).where("a != b").distinct(), "edges")
        discard(old)
        now = sign(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
