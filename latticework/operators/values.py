"""Values of nodes: seeds, probabilities and memberships as tables (id, value) or (id, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, get_adjacency, weights
from ..sources.tables import numbered

Given = DataFrame | dict | list | tuple | None


def as_table(spark: SparkSession, values: Given, n: int | None = None) -> DataFrame | None:
    """(id, value) of a table, a dict of nodes or a list with one value a node; ValueError if its length isn't n."""
    if values is None or isinstance(values, DataFrame):
        return values
    if isinstance(values, dict):
        rows = values.items()
    else:
        if n is not None and len(values) != n:
            raise ValueError(f"{len(values)} values were given, {n} are needed")
        rows = enumerate(values)
    return spark.createDataFrame([(int(i), float(v)) for i, v in rows], "id bigint, value double")


def get_values(spark: SparkSession, n: int, values: Given = None, default_value: float = -1) -> DataFrame:
    """(id, value) of nodes 0..n-1: the given ones, else the default; all ones where none are given."""
    told = as_table(spark, values, n)
    if told is None:
        return spark.range(n).select("id", F.lit(1.0).alias("value"))
    return spark.range(n).join(told.select("id", "value"), "id", "left").select("id", F.coalesce("value", F.lit(float(default_value))).alias("value"))


def stack_values(spark: SparkSession, shape: tuple[int, int], values_row: Given = None, values_col: Given = None, default_value: float = -1) -> DataFrame:
    """Values of rows, then of columns, as nodes of the block graph; with neither given, ones on rows, defaults on columns."""
    n_row, n_col = shape
    nothing = lambda n: spark.range(n).select("id", F.lit(float(default_value)).alias("value"))
    rows = get_values(spark, n_row, values_row, default_value) if values_row is not None or values_col is None else nothing(n_row)
    cols = nothing(n_col) if values_col is None else get_values(spark, n_col, values_col, default_value)
    return rows.unionByName(cols.select((F.col("id") + n_row).alias("id"), "value"))


def values2prob(values: DataFrame) -> DataFrame:
    """The positive values over their sum, the others 0; ValueError if none is positive."""
    total = values.agg(F.sum(F.when(F.col("value") > 0, F.col("value")))).first()[0]
    if not total:
        raise ValueError("at least one value has to be positive")
    return values.select("id", F.when(F.col("value") > 0, F.col("value") / total).otherwise(0.0).alias("value"))


def get_adjacency_values(graph: Graph, allow_directed: bool = True, force_bipartite: bool = False, force_directed: bool = False, values: Given = None, values_row: Given = None, values_col: Given = None, default_value: float = -1, which: str | None = None) -> tuple[Graph, DataFrame, bool]:
    """The square graph, its nodes' values, and whether it was made of two sides.

    which: 'probs' divides by the sum if that is positive; 'labels' gives each node its own where all given ones are equal.
    """
    spark = graph.edges.sparkSession
    force = force_bipartite or values_row is not None or values_col is not None
    square = get_adjacency(graph, allow_directed, force, force_directed)
    bipartite = square.n != graph.n_row or graph.bipartite
    shape = (graph.n_row, graph.n_col)
    if bipartite:
        told = stack_values(spark, shape, values_row if values is None else values, values_col if values is None else None, default_value)
    else:
        told = get_values(spark, graph.n_row, values, default_value)
    if which == "probs":
        total = told.agg(F.sum("value")).first()[0] or 0.0
        if total > 0:
            told = told.select("id", (F.col("value") / total).alias("value"))
    elif which == "labels":
        if told.where("value >= 0").select("value").distinct().limit(2).count() == 1:
            told = told.select("id", F.col("id").cast("double").alias("value"))
    return square, told, bipartite


def split_sides(table: DataFrame, n_row: int) -> tuple[DataFrame, DataFrame]:
    """A table keyed by id of a block graph, as rows and as columns with ids of their own."""
    return table.where(F.col("id") < n_row), table.where(F.col("id") >= n_row).withColumn("id", F.col("id") - n_row)


def get_membership(labels: DataFrame, n_labels: int | None = None) -> tuple[DataFrame, int]:
    """(src, dst, weight) of nodes and their labels, negative ones left out, and the number of columns."""
    told = labels.where("label >= 0").select(F.col("id").alias("src"), F.col("label").cast("bigint").alias("dst"), F.lit(1.0).alias("weight"))
    if n_labels is None:
        n_labels = (told.agg(F.max("dst")).first()[0] if not told.isEmpty() else -1) + 1
    return told, n_labels


def from_membership(membership: DataFrame, n: int) -> DataFrame:
    """(id, label) of nodes 0..n-1, -1 for those without one."""
    told = membership.where("weight != 0").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("label"))
    return membership.sparkSession.range(n).join(told, "id", "left").select("id", F.coalesce("label", F.lit(-1).cast("bigint")).alias("label"))


def submatrix(graph: Graph, rows: DataFrame, cols: DataFrame | None = None) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph on the given nodes, numbered anew in their order; with (id, old) of rows and of columns."""
    places = lambda t: numbered(t.select(F.col("id").alias("name")).distinct()).withColumnRenamed("name", "old")
    r = places(rows)
    c = r if cols is None else places(cols)
    edges = graph.edges.join(r.select(F.col("old").alias("src"), F.col("id").alias("a")), "src").join(c.select(F.col("old").alias("dst"), F.col("id").alias("b")), "dst")
    return Graph(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), r.count(), c.count(), graph.bipartite), r, c


def node_weights(graph: Graph, distribution: str = "degree") -> DataFrame:
    """(id, weight): row sums ('degree') or ones ('uniform')."""
    if distribution == "degree":
        return weights(graph).withColumn("weight", F.col("weight").cast("double"))
    if distribution == "uniform":
        return graph.edges.sparkSession.range(graph.n_row).select("id", F.lit(1.0).alias("weight"))
    raise ValueError(f"weights are 'degree' or 'uniform', not {distribution!r}")


def check_weights(given: str | DataFrame, graph: Graph, positive_entries: bool = False) -> DataFrame:
    """(id, weight) of all nodes; ValueError where one is negative, all are zero, or one isn't positive but has to be."""
    told = node_weights(graph, given) if isinstance(given, str) else given.select("id", F.col("weight").cast("double").alias("weight"))
    n, low, total = told.agg(F.count("*"), F.min("weight"), F.sum("weight")).first()
    if n != graph.n_row:
        raise ValueError(f"{n} weights were given, {graph.n_row} are needed")
    if low < 0 or not total or (positive_entries and low <= 0):
        raise ValueError("weights have to be positive" if positive_entries else "weights have to be at least 0, and one above")
    return told


def get_probs(given: str | DataFrame, graph: Graph, positive_entries: bool = False) -> DataFrame:
    """(id, prob): weights over their sum."""
    told = check_weights(given, graph, positive_entries)
    total = told.agg(F.sum("weight")).first()[0]
    return told.select("id", (F.col("weight") / total).alias("prob"))
