"""Predicates of graphs and vectors, and guards that raise where one fails.  Each is an aggregate of at most one row."""

from __future__ import annotations

import random
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, is_symmetric
from .topology import is_connected


def _all(table: DataFrame, condition) -> bool:
    return table.where(~F.coalesce(condition, F.lit(False))).isEmpty()


def is_square(graph: Graph) -> bool:
    return not graph.bipartite and graph.n_row == graph.n_col


def has_nonnegative_entries(table: DataFrame, column: str = "weight") -> bool:
    return _all(table, F.col(column) >= 0)


def has_positive_entries(table: DataFrame, column: str = "weight") -> bool:
    return _all(table, F.col(column) > 0)


def has_boolean_entries(table: DataFrame, column: str = "weight") -> bool:
    """Whether the column is boolean, or holds only 0 and 1."""
    return table.schema[column].dataType.typeName() == "boolean" or _all(table, F.col(column).isin(0, 1))


def is_proba(table: DataFrame, by: str = "src", column: str = "weight") -> bool:
    """Whether entries are at least 0 and add up to 1 in every row."""
    return has_nonnegative_entries(table, column) and _all(table.groupBy(by).agg(F.sum(column).alias("s")), F.abs(F.col("s") - 1) < 1e-9)


def is_weakly_connected(graph: Graph) -> bool:
    return is_connected(graph)


def has_self_loops(graph: Graph) -> bool:
    """Whether every node has one."""
    loops = graph.edges.where("src = dst and weight != 0").select(F.col("src").alias("id"))
    return graph.edges.sparkSession.range(graph.n_row).join(loops, "id", "left_anti").isEmpty()


def add_self_loops(graph: Graph) -> Graph:
    """A plus the identity, of as many ones as the shorter side has nodes."""
    spark = graph.edges.sparkSession
    ones = spark.range(min(graph.n_row, graph.n_col)).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    merged = graph.edges.unionByName(ones).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return Graph(merged, graph.n_row, graph.n_col, graph.bipartite)


def _must(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


def check_format(graph: Graph, allow_empty: bool = False) -> Graph:
    """TypeError if it isn't a graph, ValueError if it has no edge and has to have one."""
    if not isinstance(graph, Graph):
        raise TypeError("a Graph is needed")
    _must(allow_empty or not graph.edges.isEmpty(), "the graph has no edge")
    return graph


def check_connected(graph: Graph) -> None:
    _must(is_weakly_connected(graph), "the graph has to be connected")


def check_nonnegative(table: DataFrame, column: str = "weight") -> None:
    _must(has_nonnegative_entries(table, column), "values have to be at least 0")


def check_positive(table: DataFrame, column: str = "weight") -> None:
    _must(has_positive_entries(table, column), "values have to be above 0")


def check_boolean(table: DataFrame, column: str = "weight") -> None:
    _must(has_boolean_entries(table, column), "values have to be boolean")


def check_square(graph: Graph) -> None:
    _must(is_square(graph), "the graph has to have as many rows as columns")


def check_symmetry(graph: Graph) -> None:
    _must(is_symmetric(graph), "the graph has to be undirected")


def check_is_proba(value: float, name: str = "the value") -> float:
    if not isinstance(value, (int, float)):
        raise TypeError(f"{name} has to be a number")
    _must(0 <= value <= 1, f"{name} has to lie between 0 and 1")
    return value


def check_damping_factor(value: float) -> float:
    _must(0 <= value < 1, "the damping factor has to be at least 0 and below 1")
    return value


def check_random_state(state: int | random.Random | None) -> random.Random:
    if state is None or isinstance(state, int):
        return random.Random(state)
    if not isinstance(state, random.Random):
        raise TypeError("a random state is a seed or a random.Random")
    return state


def check_n_neighbors(n_neighbors: int, n_seeds: int) -> int:
    """At most n_seeds - 1, with a warning."""
    if n_neighbors >= n_seeds:
        warnings.warn(f"{n_neighbors} neighbours are asked for, {n_seeds - 1} are there", stacklevel=2)
        return n_seeds - 1
    return n_neighbors


def check_labels(labels: DataFrame) -> tuple[list[int], int]:
    """The classes that aren't negative, and how many; ValueError if fewer than two."""
    classes = sorted(r[0] for r in labels.where("label >= 0").select("label").distinct().collect())  # classes, not nodes
    _must(len(classes) >= 2, "two labels at least have to be given")
    return classes, len(classes)


def check_n_jobs(n_jobs: int | None = None) -> int | None:
    """None: as many as there are.  Spark decides; kept for callers that pass it."""
    return None if n_jobs == -1 else n_jobs or 1


def check_adjacency_vectors(vectors: DataFrame, n: int) -> DataFrame:
    """Rows (src, dst, weight) of new nodes; ValueError if one leads to a node that isn't there."""
    _must(_all(vectors, F.col("dst").between(0, n - 1)), f"columns have to lie below {n}")
    return vectors


def check_n_clusters(n_clusters: int, n_row: int, n_min: int = 0) -> None:
    _must(n_clusters <= n_row, "more clusters than rows are asked for")
    _must(n_clusters >= n_min, f"{n_min} clusters at least are needed")


def check_min_size(n_row: int, n_min: int) -> None:
    _must(n_row >= n_min, f"the graph has to have {n_min} nodes at least")


def check_min_nnz(n_edges: int, n_min: int) -> None:
    _must(n_edges >= n_min, f"the graph has to have {n_min} edges at least")


def check_dendrogram(dendrogram: DataFrame) -> None:
    _must({"step", "left", "right", "height", "size"} <= set(dendrogram.columns), "a dendrogram has the columns step, left, right, height and size")


def check_n_components(n_components: int, most: int) -> int:
    """At most so many, with a warning."""
    if n_components > most:
        warnings.warn(f"an embedding of {most} dimensions at most is possible", stacklevel=2)
        return most
    return n_components


def check_scaling(scaling: float, graph: Graph, regularize: bool) -> None:
    _must(scaling >= 0, "scaling has to be at least 0")
    _must(not scaling or regularize or is_weakly_connected(graph), "scaling needs a connected graph or regularization")


def check_same_length(x: DataFrame, y: DataFrame) -> None:
    _must(x.count() == y.count(), "the vectors have to have the same length")
