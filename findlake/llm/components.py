"""Connected components of an edge table, by star contraction with a table written each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
    least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("m", "n").alias("m"))
    return both.join(least, "n").where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` for each node of ``edges`` (columns ``u``, ``v``, one orderable type); component is the smallest node.

    Loops and repeated edges do no harm; edges with a null end are left out; an empty table gives an empty one.
    The number of rounds grows with the logarithm of the longest path. All joins are on a node whose rows
    Spark can split, and minima are taken before the shuffle, so that a star with most of the nodes is no hot spot.
    A round's table and shuffle files are gone when the next round's is written, so disk doesn't grow with the rounds.
    """
    current = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        before, current = current, materialize(_small_star(_large_star(current)), "stars")
        discard(before)
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
