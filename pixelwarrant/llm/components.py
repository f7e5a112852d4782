"""Distributed union-find: connected components of an edge table by alternating stars, DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelwarrant.llm.shared import stored


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of every u, itself included; partial minima are formed before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """`node` and the least node (`root`) that it is linked to, over the nodes of at least one link between different nodes.

    Large star: every neighbour of u above u moves to u's least neighbour. Small star: the neighbours of u not above it, and u
    itself, move to the least of them. Both keep components and end, after a logarithmic number of rounds, in one star for each.
    No neighbour list is gathered: a hub is a partial minimum and one side of a join that adaptive execution can split.
    Null and self links are left out; an empty table gives an empty one. Each round is written to the shared folder.
    """
    # Kept as u > v.
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges)
    state = None
    for _ in range(rounds):
        both = _both(edges)
        large = both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct())
        least = _least(large)
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # The edges are at rest when a round leaves their number and their sums as they were.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
