"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours under the least node it sees."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(low, both.u == low.w).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours under the least of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "w")
    joined = edges.join(low, edges.a == low.w).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(low.select("w", "m")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that is not the least of its component.

    ``edges`` has long columns a and b, in any order, repeated or not; loops
    and nulls are ignored.  The component is its least node.  Each round is
    written to the shared folder and compared with the last by row count and
    hash sum; hubs need no gathering, because neighbours are only ever reduced
    by a minimum and joined back.  Rounds grow with the logarithm of the longest
    path; if ``rounds`` don't suffice, that is an error, not a partial result.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.keep(edges)

    def mark(t):
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        after = scratch.keep(_small_star(_large_star(edges)))
        scratch.drop(edges)
        edges, now = after, mark(after)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
