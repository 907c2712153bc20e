"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the links and is written to the shared folder, so a lost
executor costs one round at most; no round collects a component or more than three numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node hands its larger neighbours the smallest of its neighbourhood; else its smaller ones."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("b").agg(F.min("a").alias("m"))  # a neighbour of b; in the small round a < b always
    least = least.select("b", F.least("m", "b").alias("m"))
    kept = edges.join(least, "b")
    if large:
        return kept.where("a > b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").distinct()
    moved = kept.where("a != m").select(F.least("m", "a").alias("a"), F.greatest("m", "a").alias("b"))
    return moved.unionByName(least.where("m < b").select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> tuple[DataFrame, str]:
    """links(a, b) of bigint -> (node, root) for every node that has a link, root its component's smallest node.

    Also gives the folder the rows lie in.  Links in either direction, repeated or from a node to itself are fine.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges, path = written(edges, "links")
    told = None
    for _ in range(rounds):
        state = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.shiftright(F.xxhash64("b", "a"), 20)), F.lit(0))).first())
        if state == told or not state[0]:
            break
        told, old = state, path
        edges, path = written(_star(_star(edges, True), False), "links")
        remove(edges.sparkSession, old)
    else:
        raise RuntimeError(f"components aren't stable after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), path
