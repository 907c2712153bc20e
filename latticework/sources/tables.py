"""Edge lists with names: reading, numbering and writing.

Names are numbered in their sorted order by a range-partitioned sort: each partition's size is counted first, so no task
sees all names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.loops import settled


def numbered(names: DataFrame) -> DataFrame:
    """names(name), distinct -> (id, name), ids 0, 1, ... in order."""
    placed = settled(names.repartitionByRange("name").sortWithinPartitions("name").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    first = sizes.withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "first")
    place = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return placed.withColumn("place", place).join(F.broadcast(first), "part").select((F.col("first") + F.col("place")).alias("id"), "name")


def from_named_edges(edges: DataFrame, bipartite: bool = False, directed: bool = True, sum_duplicates: bool = True) -> tuple[Graph, DataFrame, DataFrame]:
    """edges(src, dst [, weight]) of any names -> graph, row names, column names (the same but for bipartite graphs).

    Edges without a source or target are left out; of repeated edges the weights add up, or one stays, the smallest.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    edges = edges.where("src is not null and dst is not null").select("src", "dst", weight.alias("weight"))
    if not (directed or bipartite):
        edges = edges.unionByName(edges.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    left, right = edges.select(F.col("src").alias("name")), edges.select(F.col("dst").alias("name"))
    rows = settled(numbered((left if bipartite else left.unionByName(right)).distinct()))
    cols = settled(numbered(right.distinct())) if bipartite else rows
    told = edges.join(rows.select(F.col("name").alias("src"), F.col("id").alias("a")), "src").join(cols.select(F.col("name").alias("dst"), F.col("id").alias("b")), "dst")
    merged = told.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg((F.sum if sum_duplicates else F.min)("weight").alias("weight"))
    return Graph(merged, rows.count(), cols.count(), bipartite), rows, cols


def from_csv(spark: SparkSession, path: str, delimiter: str = ",", comment: str = "#", **how) -> tuple[Graph, DataFrame, DataFrame]:
    """An edge list of two or three columns, read by Spark's own reader."""
    read = spark.read.csv(path, sep=delimiter, comment=comment, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return from_named_edges(read.toDF(*["src", "dst", "weight"][: len(read.columns)]), **how)


def from_adjacency_list(lists: DataFrame, **how) -> tuple[Graph, DataFrame, DataFrame]:
    """lists(node, neighbors array)."""
    return from_named_edges(lists.select(F.col("node").alias("src"), F.explode("neighbors").alias("dst")), **how)


def save(graph: Graph, path: str) -> None:
    """Edges as Parquet, the sizes beside them."""
    spark = graph.edges.sparkSession
    graph.edges.write.parquet(f"{path}/edges")
    spark.createDataFrame([(graph.n_row, graph.n_col, graph.bipartite)], "n_row bigint, n_col bigint, bipartite boolean").write.parquet(f"{path}/shape")


def load(spark: SparkSession, path: str) -> Graph:
    shape = spark.read.parquet(f"{path}/shape").first()
    return Graph(spark.read.parquet(f"{path}/edges"), shape["n_row"], shape["n_col"], shape["bipartite"])
