"""Graphs made from a rule or by chance: but for albert_barabasi(), their edges are a projection of a range, and nothing is built on
the driver.  Chance is a hash of the pair and the seed."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, directed2undirected


def _graph(edges: DataFrame, n: int) -> Graph:
    return Graph(edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"), F.lit(1.0).alias("weight")), n, n)


def linear_digraph(spark: SparkSession, n: int = 3) -> Graph:
    return _graph(spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), n)


def linear_graph(spark: SparkSession, n: int = 3) -> Graph:
    return directed2undirected(linear_digraph(spark, n), weighted=False)


def cyclic_digraph(spark: SparkSession, n: int = 3) -> Graph:
    return _graph(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")), n)


def cyclic_graph(spark: SparkSession, n: int = 3) -> Graph:
    return directed2undirected(cyclic_digraph(spark, n), weighted=False)


def star(spark: SparkSession, n_branches: int = 3) -> Graph:
    """Node 0 in the middle."""
    return directed2undirected(_graph(spark.range(1, n_branches + 1).select(F.lit(0).alias("src"), F.col("id").alias("dst")), n_branches + 1), weighted=False)


def grid(spark: SparkSession, n1: int = 10, n2: int = 10) -> Graph:
    """Node i * n2 + j at row i, column j, linked to those right of it and below it."""
    cell = spark.range(n1 * n2)
    right = cell.where((F.col("id") + 1) % n2 != 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    below = cell.where(F.col("id") < (n1 - 1) * n2).select(F.col("id").alias("src"), (F.col("id") + n2).alias("dst"))
    return directed2undirected(_graph(right.unionByName(below), n1 * n2), weighted=False)


def cyclic_position(spark: SparkSession, n: int) -> DataFrame:
    """(id, x, y): the nodes evenly on a circle."""
    angle = 2 * math.pi * F.col("id") / n
    return spark.range(n).select("id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def _chance(seed: int, *columns) -> F.Column:
    """A number between 0 and 1 told by a hash, so that reruns and retried tasks agree."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def block_model(spark: SparkSession, sizes: list[int], p_in: float | list[float] = 0.2, p_out: float = 0.05, directed: bool = False, self_loops: bool = False, metadata: bool = False, seed: int = 42) -> Graph | tuple[Graph, DataFrame]:
    """Each pair of nodes is linked by chance: p_in inside a block, p_out between blocks.  With metadata, also (id, label).

    Row i draws the gaps between its successors, so that the work grows with the links rather than with the pairs: a gap of a block
    pair of chance p is the integer part of log(u) / log(1 - p).
    """
    inside = [p_in] * len(sizes) if isinstance(p_in, (int, float)) else list(p_in)
    if len(inside) != len(sizes):
        raise ValueError("a chance for each block is needed")
    if any(not 0 <= p <= 1 for p in [*inside, p_out]):
        raise ValueError("chances lie between 0 and 1")
    begins = [sum(sizes[:i]) for i in range(len(sizes))]
    n, parts = sum(sizes), []
    for a, (begin_a, size_a) in enumerate(zip(begins, sizes)):
        for b, (begin_b, size_b) in enumerate(zip(begins, sizes)):
            p = inside[a] if a == b else p_out
            if not p or (not directed and b < a):
                continue
            rows = spark.range(begin_a, begin_a + size_a).withColumnRenamed("id", "src")
            # enough gaps to pass the block's end: the mean and twelve deviations more
            many = size_b if p == 1 else min(size_b, int(size_b * p + 12 * math.sqrt(size_b * p * (1 - p)) + 12))
            gap = F.lit(1) if p == 1 else F.floor(F.log(F.greatest(_chance(seed, "src", F.lit(b), "k"), F.lit(1e-12))) / math.log(1 - p)) + 1
            gaps = rows.select("src", F.explode(F.sequence(F.lit(1), F.lit(many))).alias("k")).select("src", "k", gap.alias("gap"))
            place = F.sum("gap").over(Window.partitionBy("src").orderBy("k")) - 1
            parts.append(gaps.select("src", place.alias("at")).where(F.col("at") < size_b).select("src", (F.col("at") + begin_b).alias("dst")))
    pairs = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "src bigint, dst bigint"))
    if not self_loops:
        pairs = pairs.where("src != dst")
    graph = _graph(pairs, n) if directed else directed2undirected(_graph(pairs.where("src <= dst"), n), weighted=False)
    if not metadata:
        return graph
    label = F.coalesce(*[F.when(F.col("id") < begin + size, F.lit(i).cast("bigint")) for i, (begin, size) in enumerate(zip(begins, sizes))])
    return graph, spark.range(n).select("id", label.alias("label"))


def erdos_renyi(spark: SparkSession, n: int = 20, p: float = 0.3, directed: bool = False, self_loops: bool = False, seed: int = 42) -> Graph:
    return block_model(spark, [n], p, 0.0, directed, self_loops, seed=seed)


def watts_strogatz(spark: SparkSession, n: int = 100, degree: int = 6, prob: float = 0.05, seed: int = 42) -> Graph:
    """A ring whose nodes are linked to their degree / 2 next ones; each link leads elsewhere with the given chance."""
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(degree // 2, 1)))).alias("k"))
    other = F.pmod(F.col("src") + 1 + F.floor(_chance(seed + 1, "src", "k") * (n - 1)), F.lit(n))
    dst = F.when(_chance(seed, "src", "k") < prob, other).otherwise((F.col("src") + F.col("k")) % n)
    return directed2undirected(_graph(ring.select("src", dst.alias("dst")).distinct(), n), weighted=False)


def albert_barabasi(spark: SparkSession, n: int = 100, degree: int = 3, directed: bool = False, seed: int = 42) -> Graph:
    """Nodes join one after the other and link to degree earlier ones, chosen by their degrees; the first ones are all linked.

    Sequential by definition, so it runs in one process; its edges, degree a node, are the bound.
    """
    if n * degree > 5_000_000:
        raise ValueError("a graph of 5 million links at most is made in one process")
    rng = random.Random(seed)
    pairs = [(i, j) for i in range(degree) for j in range(i)]
    ends = [x for p in pairs for x in p] or list(range(degree))
    for i in range(degree, n):
        chosen: set[int] = set()
        while len(chosen) < min(degree, i):
            chosen.add(rng.choice(ends))
        for j in sorted(chosen):
            pairs.append((i, j))
            ends += (i, j)
    graph = _graph(spark.createDataFrame(pairs, "src bigint, dst bigint"), n)
    return graph if directed else directed2undirected(graph, weighted=False)
