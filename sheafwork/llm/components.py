"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheafwork.llm.tables import shared

ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least node
    around it; the links shrink to stars in a number of rounds that grows with the logarithm of the
    longest path.  Only minima are taken per node, so a node with very many links is no burden.
    Each round is written to the shared folder.
    """
    edges = shared(_downward(links.select("a", "b")), "edges")
    seen = _summary(edges)
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = shared(_downward(larger), "large-star")
        under = large.groupBy("a").agg(F.min("b").alias("low"))
        smaller = large.join(under, "a")
        small = smaller.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            under.select("a", F.col("low").alias("b"))
        )
        following = shared(_downward(small), "small-star")
        edges, before, seen = following, seen, _summary(following)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _downward(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller node, each once, none to itself."""
    return links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a > b").distinct()
