"""Connected components of a graph too large for one machine, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gatewell.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that is not itself a root.

    The root is the smallest node of its component. In each round every node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows; rounds go on until nothing
    changes, which takes about as many as the logarithm of the longest chain. Only minima are taken
    per node, combined before the shuffle, so a node with very many neighbours is never gathered;
    the joins read written tables and adaptive execution splits their skewed parts.

    Edges from a node to itself or to null are ignored; repeated edges count once.
    """
    pairs = materialize(
        edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        .where("u IS NOT NULL AND v IS NOT NULL AND a > b").distinct(), "star")
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"),
                                                            F.col("m").alias("b")).distinct()
        large = materialize(large, "star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        pairs = materialize(small, "star")
        previous, state = state, _state(pairs)
        if state == previous:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(pairs: DataFrame) -> tuple:
    """Two equal states mean equal pairs: the number and a sum of hashes."""
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
                    .alias("h")).first()
    return row["n"], row["h"]
