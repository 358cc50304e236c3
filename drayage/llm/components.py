"""Connected components of links, by alternating stars.

Every round shuffles the links that are left; a hub is a minimum that is
combined before the shuffle, and a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from drayage.session import materialise


def stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and a hash of them all."""
    seen = Observation()
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("hash"))
    return materialise(told, "links"), (seen.get["n"], seen.get["hash"])


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def partly_joined(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id``, ``component``: ids of one name are connected, but not all that are connected have one name.

    A single round, for where a rough answer will do.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    moved = small_star(large_star(edges))
    return materialise(moved.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "joined")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id``, ``component`` of every linked id but the smallest of each component.

    ``a`` and ``b`` are whole numbers; rows with a null and links of an id to
    itself say nothing. The component is named after its smallest id.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges, state = stored(pairs.distinct())
    while state[0]:
        edges, now = stored(small_star(large_star(edges)))
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
