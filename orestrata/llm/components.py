"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orestrata.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a``, ``b``); the root is the least node reachable.

    Each round hangs neighbours on the least node that their neighbour sees: first
    larger neighbours of every node (large star), then smaller ones (small star).
    The least neighbour is found by a sum that combines on the map side, and the
    join that follows can be split where one node has very many neighbours, so no
    neighbourhood meets in one task. The number of rounds grows with the logarithm
    of the longest path. Edges go to the shared checkpoint folder after each round.
    """
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = _star(_star(now, True), False)
        now = cut(now)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` are (u, v) with v < u. Large: every neighbour above a node goes to the least around it;
    small: the node and its neighbours below it go to the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    j = both.join(least, "u")
    if large:
        out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()
