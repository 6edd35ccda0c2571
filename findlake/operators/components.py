"""Connected components of edges between any two kinds of ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.operators.numbering import stored


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` of the nodes of ``edges`` (u, v; one orderable type): the component is the smallest node that can be reached.

    Stars are contracted in turn, to the larger and to the smaller neighbours, so the number of rounds grows with the logarithm of
    the longest path; each is settled. Minima are taken before rows are shuffled, so a node with many edges is no hot spot.
    """
    current = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = current.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(current.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("m", "n").alias("m"))
        large = both.join(least, "n").where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-stars")  # it is read twice
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        current = stored(large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = state
    raise RuntimeError(f"components have not settled after {rounds} rounds")
