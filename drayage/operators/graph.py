"""Migration order of tables: waves of a reference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.session import materialise


# Rounds after which what was given out is written as one table.
FOLD_ROUNDS = 8


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with their chains drawn together: the edges left, places in chains, and nodes of closed chains.

    A link of a chain is a node with one parent and one child. Each points to
    its parent first and then, round by round, to where that one points, twice as far
    every time, until all point to a node that is no link. Links that still
    point to a link after as many rounds as that can take are a closed chain. The
    edges left are ``child, parent, weight``; a place is ``node, top, distance``.
    """
    ups = edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("top")).filter("n = 1")
    downs = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("m")).filter("m = 1")
    links = ups.join(downs, "node").select("node", "top", F.lit(1).cast("long").alias("distance"))
    links = materialise(links, "chains")
    names = materialise(links.select("node"), "chain-links")
    count = names.count()
    for _ in range(count.bit_length()):
        step = links.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("distance").alias("_more"))
        if links.join(names.select(F.col("node").alias("top")), "top", "left_semi").isEmpty():
            break
        links = materialise(
            links.join(step, "top", "left").select(
                "node", F.coalesce("_top", "top").alias("top"), (F.col("distance") + F.coalesce("_more", F.lit(0))).alias("distance")
            ),
            "chains",
        )
    closed = links.join(names.select(F.col("node").alias("top")), "top", "left_semi").select("node")
    closed = materialise(closed, "closed-chains")
    places = links.join(closed, "node", "left_anti")
    kept = edges.join(names.select(F.col("node").alias("child")), "child", "left_anti")
    over = places.select(F.col("node").alias("parent"), F.col("top").alias("_top"), "distance")
    short = kept.join(over, "parent", "left").select(
        "child", F.coalesce("_top", "parent").alias("parent"), (F.coalesce("distance", F.lit(0)) + 1).alias("weight")
    )
    return materialise(short.groupBy("child", "parent").agg(F.max("weight").alias("weight")), "short-edges"), places, closed


def dependency_waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Wave of each table: 1 + the largest wave among the tables it refers to.

    ``nodes`` holds ``node, row_count``; ``edges`` holds ``child, parent``.
    References to itself or to unknown nodes do not hold a table back. Tables
    on or behind a cycle have no wave (NULL). Order by ``wave, row_count``.

    Chains are drawn together first, in rounds that double the distance. What is
    left is worked off level by level: nodes without a parent that still waits
    are given out, and tell their children how far down these are at
    least. Work shrinks with what is left, and rounds stop when nothing
    more is given out.
    """
    known = nodes.select("node").distinct()
    given = edges.select("child", "parent").distinct().filter("child <> parent")
    for end in ("parent", "child"):
        given = given.join(known.withColumnRenamed("node", end), end, "left_semi")
    given = materialise(given.select("child", "parent"), "references")
    waiting, places, closed = contracted(given)
    # How far down the nodes that wait are at least, by what has been given out above them.
    depth = waiting.select(F.col("child").alias("node")).distinct().withColumn("depth", F.lit(0).cast("long"))
    depth = materialise(depth, "depths")
    roots = waiting.select(F.col("parent").alias("node")).distinct().join(depth, "node", "left_anti")
    last = materialise(roots.withColumn("depth", F.lit(0).cast("long")), "given-out")
    found, left, rounds = last.limit(0), depth.count(), 0
    while left:
        rounds += 1
        told = waiting.join(last.withColumnsRenamed({"node": "parent", "depth": "_above"}), "parent")
        deeper = told.groupBy(F.col("child").alias("node")).agg(F.max(F.col("_above") + F.col("weight")).alias("_d"))
        waiting = waiting.join(last.select(F.col("node").alias("parent")), "parent", "left_anti")
        waiting = materialise(waiting.select("child", "parent", "weight"), "waiting")
        held = waiting.select(F.col("child").alias("node")).distinct().withColumn("_held", F.lit(True))
        deepest = F.greatest("depth", F.coalesce("_d", F.lit(0))).alias("depth")
        seen = depth.join(deeper, "node", "left").select("node", deepest).join(held, "node", "left")
        seen = materialise(seen, "depths")
        last, depth = seen.filter("_held IS NULL").select("node", "depth"), seen.filter("_held").select("node", "depth")
        found = found.unionAll(last)
        if rounds % FOLD_ROUNDS == 0:
            found = materialise(found, "given-out")
        before, left = left, depth.count()
        if left == before:
            break
    stuck = depth.select("node").unionAll(closed)
    in_chain = places.withColumnRenamed("node", "_node").join(found.withColumnRenamed("node", "top"), "top", "left")
    in_chain = in_chain.join(stuck.withColumnRenamed("node", "top").withColumn("_stuck", F.lit(True)), "top", "left")
    chained = in_chain.filter("_stuck IS NULL").select(F.col("_node").alias("node"), (F.coalesce("depth", F.lit(0)) + F.col("distance")).alias("depth"))
    behind = in_chain.filter("_stuck").select(F.col("_node").alias("node"))
    marked = found.unionAll(chained).select("node", "depth", F.lit(False).alias("_stuck")).unionAll(
        stuck.unionAll(behind).select("node", F.lit(None).cast("long"), F.lit(True))
    )
    joined = nodes.join(marked, "node", "left")
    wave = F.when(F.coalesce("_stuck", F.lit(False)), F.lit(None)).otherwise(F.coalesce("depth", F.lit(0)) + 1).cast("int")
    return joined.withColumn("wave", wave).drop("depth", "_stuck")
