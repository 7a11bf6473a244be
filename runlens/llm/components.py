"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runlens.session import materialize

#: rounds needed grow with the logarithm of the longest path squared
MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges (a, b)``.

    Returns (node, root) for every node that has an edge to another node; a
    node without one is its own component and is not listed. Edges with a null
    end or equal ends are ignored, repeated edges count once. Each round links
    every node's larger neighbours, then its smaller ones, to the smallest
    node around it, until each tree is a star. Minima are combined before each
    shuffle, so a node with very many links adds one row a task; the joins
    that hand a minimum back have one row a node on one side, which lets the
    planner split a hot node. Rounds are written to the shared folder.
    """
    stars = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = stars.agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
        if seen == state or not state["n"]:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")) \
                .unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
                             .distinct())
        seen = state
        stars = materialize(_small_star(_large_star(stars)), "links")
    raise RuntimeError("components did not settle")


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")) \
        .unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")) \
        .select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u") \
        .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("hi").agg(F.min("lo").alias("m"))
    return stars.join(least, "hi").select(F.explode(F.array(
        F.struct("hi", F.col("m").alias("lo")),
        F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")) \
        .select("e.hi", "e.lo").where("hi <> lo").distinct()
