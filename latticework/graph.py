"""The graph data model: a node table, an edge table and how the two kinds of graph turn into each other.

edges(src, dst, weight) and nodes(id) are DataFrames.  A biadjacency graph keeps two id spaces of n_row and n_col
nodes; as an adjacency its columns follow its rows.  Isolated nodes are real: nodes never come from edges alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    n_row: int
    n_col: int
    bipartite: bool = False

    @property
    def n(self) -> int:
        return self.n_row + self.n_col if self.bipartite else self.n_row

    @property
    def nodes(self) -> DataFrame:
        return self.edges.sparkSession.range(self.n)

    def transpose(self) -> Graph:
        turned = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return replace(self, edges=turned, n_row=self.n_col, n_col=self.n_row)


def from_edges(edges: DataFrame, n: int) -> Graph:
    return Graph(edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"), F.col("weight").cast("double")), n, n)


def from_biadjacency(edges: DataFrame, n_row: int, n_col: int) -> Graph:
    return replace(from_edges(edges, n_row), n_col=n_col, bipartite=True)


def from_list(spark: SparkSession, pairs, n: int | None = None) -> Graph:
    rows = [(int(p[0]), int(p[1]), float(p[2]) if len(p) > 2 else 1.0) for p in pairs]
    n = max([n or 0, *(1 + max(a, b) for a, b, _ in rows)])
    return from_edges(spark.createDataFrame(rows, "src bigint, dst bigint, weight double"), n)


def directed2undirected(graph: Graph, weighted: bool = True) -> Graph:
    """A + its transpose: self-loops double, reciprocal weights add.  weighted=False: every pair once, weight 1."""
    both = graph.edges.unionByName(graph.transpose().edges)
    summed = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return replace(graph, edges=summed if weighted else summed.withColumn("weight", F.lit(1.0)))


def bipartite2directed(graph: Graph) -> Graph:
    n = graph.n_row + graph.n_col
    return Graph(graph.edges.withColumn("dst", F.col("dst") + graph.n_row), n, n)


def bipartite2undirected(graph: Graph) -> Graph:
    block = bipartite2directed(graph)
    return replace(block, edges=block.edges.unionByName(block.transpose().edges))


def is_symmetric(graph: Graph) -> bool:
    one = graph.edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    other = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    odd = one.join(other, ["src", "dst"], "full").where(~F.col("w").eqNullSafe(F.col("v")))
    return graph.n_row == graph.n_col and odd.isEmpty()


def get_adjacency(graph: Graph, allow_directed: bool = True, force_bipartite: bool = False, force_directed: bool = False) -> Graph:
    """Bipartite where it is, is forced, or a directed graph isn't allowed."""
    if graph.bipartite or force_bipartite or not (allow_directed or is_symmetric(graph)):
        return bipartite2directed(graph) if force_directed else bipartite2undirected(graph)
    return graph


def degrees(graph: Graph, transpose: bool = False) -> DataFrame:
    """(id, degree): stored entries of each row, or column."""
    return _per_node(graph, transpose, F.count("*").alias("degree"))


def weights(graph: Graph, transpose: bool = False) -> DataFrame:
    """(id, weight): sum of each row, or column."""
    return _per_node(graph, transpose, F.sum("weight").alias("weight"))


def _per_node(graph: Graph, transpose: bool, aggregate) -> DataFrame:
    n, side = (graph.n_col, "dst") if transpose else (graph.n_row, "src")
    nodes = graph.edges.sparkSession.range(n)
    return nodes.join(graph.edges.groupBy(F.col(side).alias("id")).agg(aggregate), "id", "left").na.fill(0)


def neighbors(graph: Graph, node: int, transpose: bool = False) -> DataFrame:
    side, other = ("dst", "src") if transpose else ("src", "dst")
    return graph.edges.where(F.col(side) == node).select(F.col(other).alias("id"))
