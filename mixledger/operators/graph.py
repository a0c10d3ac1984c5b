"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node hangs its larger (or its smaller) neighbours on the least of them.

    ``edges`` holds (a, b) with a > b. The least neighbour of a node is a combined minimum; the
    join that hands it out is on the node, and adaptive execution splits a node with many edges.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # A neighbour b below a stays as it is when a is reached from b's side.
        moved = both.join(least, "a").where(F.col("b") > F.col("a"))
        step = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a")
        step = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return step.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: root is the least node it can reach.

    ``edges``: columns a and b of one ordered type; order, repeats and loops do not matter. Large
    and small stars alternate until nothing changes, a number of rounds that grows with the
    logarithm of the component size. Each round is cut by a checkpoint in the shared folder; the
    driver sees only a count and a sum of hashes. No edge: an empty result.
    """
    now = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )

    def mark(df: DataFrame) -> tuple:
        hashed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        return tuple(df.agg(F.count("*"), hashed).first())

    before = mark(now)
    while before[0]:
        now = cut_lineage(_star(_star(now, True), False))
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
