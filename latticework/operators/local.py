"""Graphs small enough for one process: collected only after their edges are counted against a bound."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

#: Edges that a graph may have to be held by the driver: three numbers each, 24 MB in all.
MOST_EDGES = 1_000_000


@dataclass
class LocalGraph:
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray
    n: int

    def summed(self) -> LocalGraph:
        """Equal pairs once, by source, then target."""
        code = self.src * self.n + self.dst
        code, place = np.unique(code, return_inverse=True)
        return LocalGraph(code // max(self.n, 1), code % max(self.n, 1), np.bincount(place, self.weight, code.size).astype(float), self.n)

    def symmetric(self) -> LocalGraph:
        """A plus its transpose."""
        return LocalGraph(np.r_[self.src, self.dst], np.r_[self.dst, self.src], np.r_[self.weight, self.weight], self.n).summed()

    def rows(self) -> list[list[tuple[int, float]]]:
        """Each node's successors, with weights."""
        found: list[list[tuple[int, float]]] = [[] for _ in range(self.n)]
        for i, j, w in zip(self.src.tolist(), self.dst.tolist(), self.weight.tolist()):
            found[i].append((j, w))
        return found

    def dense(self, n_col: int | None = None) -> np.ndarray:
        matrix = np.zeros((self.n, n_col or self.n))
        np.add.at(matrix, (self.src, self.dst), self.weight)
        return matrix


def fits(graph: Graph, most: int = MOST_EDGES) -> bool:
    return max(graph.n, graph.n_row) <= most and graph.edges.limit(most + 1).count() <= most


def collected(graph: Graph, most: int = MOST_EDGES) -> LocalGraph:
    """The graph on the driver; ValueError if it has more edges, or nodes, than the bound."""
    rows = graph.edges.select("src", "dst", "weight").orderBy("src", "dst").limit(most + 1).toPandas()
    if len(rows) > most or max(graph.n, graph.n_row) > most:
        raise ValueError(f"this operator holds the graph in one process and takes {most} edges at most")
    return LocalGraph(rows["src"].to_numpy(np.int64), rows["dst"].to_numpy(np.int64), rows["weight"].to_numpy(float), graph.n)


def as_rows(spark: SparkSession, schema: str, *columns) -> DataFrame:
    """A table of equally long arrays."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]
    if not len(columns[0]):
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(pd.DataFrame(dict(zip(names, columns))), schema)


def by_node(spark: SparkSession, values, name: str = "value", kind: str = "double") -> DataFrame:
    """(id, name) of an array with one entry a node."""
    values = np.asarray(values)
    return as_rows(spark, f"id bigint, {name} {kind}", np.arange(len(values)), values)


def vector(table: DataFrame, n: int, column: str = "value", default: float = 0.0) -> np.ndarray:
    """The array of (id, column)."""
    told = np.full(n, default, float)
    rows = table.select("id", F.col(column).alias("v")).toPandas()
    told[rows["id"].to_numpy(np.int64)] = rows["v"].to_numpy(float)
    return told
