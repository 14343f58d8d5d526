"""Connected components by alternating stars, on tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.session import materialise


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of ``links``.

    Every round hangs each node's larger neighbours, then its smaller ones, below the smallest of them. Links only
    ever shrink in number, the minimum is combined before the shuffle, and each round is a table in the shared folder.
    Null ends and links of a node to itself are left out.
    """
    edges = materialise(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    while True:
        large = _large_star(edges)
        small = materialise(_small_star(large))
        unchanged = _digest(small) == _digest(edges)
        edges = small
        if unchanged:
            break
    members = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return members.union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Two tables of distinct links with the same digest hold the same links."""
    row = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.bit_xor(row), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node around it."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.where("v > u").join(least, "u")
    return joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = edges.join(least, "hi")
    onward = joined.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return onward.union(least.select("hi", F.col("m").alias("lo"))).distinct()
