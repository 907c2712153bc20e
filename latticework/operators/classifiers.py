"""Node classification from seeds(id, label); negative labels are no seeds.

All classes are one plan, keyed by (id, label), and only entries that differ from 0 are rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, get_adjacency, weights
from .loops import settled
from .ranking import normalized_rows
from .topology import hops_from


def _step(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(id, label, value): sum over a row's edges of weight times x at dst, for each label."""
    told = x.withColumnRenamed("id", "dst")
    return edges.join(told, "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def _best(x: DataFrame) -> DataFrame:
    """The row with the largest value of each id, ties to the smaller label."""
    top = x.groupBy("id").agg(F.max_by(F.struct("label", "value"), F.struct(F.round("value", 12), -F.col("label"))).alias("top"))
    return top.select("id", "top.label", "top.value")


def pagerank_classifier(graph: Graph, seeds: DataFrame, damping_factor: float = 0.85, n_iter: int = 10) -> DataFrame:
    """(id, label, prob): the class whose PageRank from its own seeds is largest, and its share of all classes'.

    Where no class leads, the smallest label with prob 0.
    """
    square = get_adjacency(graph)
    known = settled(seeds.where("label >= 0").select("id", "label"))
    out = weights(square).select("id", F.col("weight").alias("out"))
    size = known.groupBy("label").agg(F.count("*").alias("size"))
    b = known.join(size, "label").join(out, "id")
    b = settled(b.select("id", "label", ((1 - damping_factor * (F.col("out") > 0).cast("int")) / F.col("size")).alias("value")))
    turned = settled(normalized_rows(square).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    x = b
    for _ in range(n_iter):
        mass = x.groupBy("label").agg(F.sum("value").alias("mass"))  # one row a class
        moved = _step(turned, x).withColumn("value", damping_factor * F.col("value"))
        back = b.join(mass, "label").select("id", "label", (F.col("value") * F.col("mass")).alias("value"))
        x = settled(moved.unionByName(back).groupBy("id", "label").agg(F.sum("value").alias("value")))
    whole = x.groupBy("label").agg(F.sum("value").alias("whole"))
    x = settled(x.join(whole, "label").select("id", "label", (F.col("value") / F.col("whole")).alias("value")))
    share = _best(x).join(x.groupBy("id").agg(F.sum("value").alias("sum")), "id").select("id", "label", (F.col("value") / F.col("sum")).alias("prob"))
    least = known.agg(F.min("label")).first()[0]
    return square.nodes.join(share, "id", "left").select("id", F.coalesce("label", F.lit(least)).alias("label"), F.coalesce("prob", F.lit(0.0)).alias("prob"))


def diffusion_classifier(graph: Graph, seeds: DataFrame, n_iter: int = 10, scale: float = 5.0, centering: bool = True) -> DataFrame:
    """(id, label, prob): heat from each class's seeds, centred by class unless told not to, hottest class and its softmax share.

    Nodes that no path from a seed reaches have label -1 and prob 0.  The starting heat of unlabelled nodes is the same
    for every class and cancels from both results, so only what comes from seeds is spread, and it stays sparse.
    """
    square = get_adjacency(graph)
    known = settled(seeds.where("label >= 0").select("id", "label"))
    hot = known.withColumn("value", F.lit(1.0))
    p = settled(normalized_rows(square).join(known.select(F.col("id").alias("src")), "src", "left_anti"))  # seeds stay
    x = hot
    for _ in range(n_iter):
        x = settled(_step(p, x).unionByName(hot))
    mean = settled(known.select("label").distinct().join(x.groupBy("label").agg(F.sum("value").alias("heat")), "label", "left").select("label", (F.coalesce("heat", F.lit(0.0)) / square.n if centering else F.lit(0.0)).alias("mean")))
    # a class that doesn't reach a node has minus its mean there; the best such class and the sum are one row
    cold = mean.agg(F.min(F.struct(F.round("mean", 12), "label", "mean")).alias("m"), F.sum(F.exp(-scale * F.col("mean"))).alias("total"))
    cold = cold.select(F.col("m.label").alias("cold_label"), (-F.col("m.mean")).alias("cold_value"), "total")
    told = x.join(mean, "label").select("id", "label", (F.col("value") - F.col("mean")).alias("value"), (F.exp(scale * (F.col("value") - F.col("mean"))) - F.exp(-scale * F.col("mean"))).alias("more"))
    told = settled(told)
    best = _best(told).join(told.groupBy("id").agg(F.sum("more").alias("more")), "id")
    reached = hops_from(square, known.select("id").distinct()).select("id", F.lit(True).alias("reached"))
    all_nodes = square.nodes.join(reached, "id", "left").join(best, "id", "left").crossJoin(F.broadcast(cold))  # one row
    warm = F.col("value").isNotNull() & ((F.round("value", 12) > F.round("cold_value", 12)) | (F.round("value", 12) == F.round("cold_value", 12)) & (F.col("label") <= F.col("cold_label")))
    value = F.when(warm, F.col("value")).otherwise(F.col("cold_value"))
    label = F.when(F.col("reached"), F.when(warm, F.col("label")).otherwise(F.col("cold_label"))).otherwise(-1)
    prob = F.when(F.col("reached"), F.exp(scale * value) / (F.col("total") + F.coalesce("more", F.lit(0.0)))).otherwise(0.0)
    return all_nodes.select("id", label.cast("bigint").alias("label"), prob.alias("prob"))


def propagation(graph: Graph, seeds: DataFrame, n_iter: int = -1, weighted: bool = True) -> DataFrame:
    """(id, label): rounds in which every unlabelled node takes its neighbours' heaviest label, ties to the smallest.

    Synchronous: all nodes vote at once on the labels of the round before, until no label changes, n_iter rounds have passed
    or, as labels may swing to and fro where all vote at once, the labels of two rounds before are back.  -1 where no vote arrived.
    """
    square = get_adjacency(graph)
    known = settled(seeds.where("label >= 0").select("id", F.col("label").cast("bigint")))
    free = square.edges.join(known.select(F.col("id").alias("src")), "src", "left_anti")
    free = settled(free.select("src", "dst", F.col("weight") if weighted else F.lit(1.0).alias("weight")))
    x, older, done = known, None, 0
    while done != n_iter:
        votes = _step(free, x.withColumn("value", F.lit(1.0)))
        new = settled(_best(votes).select("id", "label").unionByName(known))
        back = any(new.join(before, ["id", "label"], "left_anti").isEmpty() for before in (x, older) if before is not None)
        older, x, done = x, new, done + 1
        if back:
            break
    return square.nodes.join(x, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def propagation_clusters(graph: Graph, n_iter: int = 5) -> DataFrame:
    """(id, label): synchronous rounds in which every node takes its neighbours' heaviest label, starting from its own."""
    edges = settled(get_adjacency(graph).edges)
    nodes = get_adjacency(graph).nodes
    x = nodes.select("id", F.col("id").alias("label"))
    for _ in range(n_iter):
        votes = _best(_step(edges, x.withColumn("value", F.lit(1.0)))).select("id", F.col("label").alias("new"))
        x = settled(x.join(votes, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    return x


def sample_neighbors(graph: Graph, size: int, seed: int = 0) -> DataFrame:
    """(src, dst): at most size neighbours of each node, chosen by a seeded hash of the pair, so reruns agree."""
    order = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "dst")
    return graph.edges.select("src", "dst", F.row_number().over(order).alias("place")).where(F.col("place") <= size).select("src", "dst")
