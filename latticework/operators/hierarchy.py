"""Dendrograms as tables: dendrogram(step, left, right, height, size) over n leaves; step t makes cluster n + t.

Climbing a tree takes as many rounds as it is deep; a round holds one row per edge or cluster still on its way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .learning import reindex_labels
from .loops import settled
from .topology import connected_components


def _parents(dendrogram: DataFrame, n: int) -> DataFrame:
    """(child, parent)."""
    child = F.explode(F.array(F.col("left").cast("bigint"), F.col("right").cast("bigint"))).alias("child")
    return dendrogram.select(child, (F.col("step") + n).cast("bigint").alias("parent"))


def _forest_labels(merges: DataFrame, n: int, sort_clusters: bool) -> DataFrame:
    """(id, label) of the leaves under the merges that are kept; a cluster's first name is its smallest leaf."""
    edges = _parents(merges, n).select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("weight"))
    part = connected_components(Graph(edges, 2 * n - 1, 2 * n - 1)).where(F.col("id") < n)
    labels = part.select("id", F.col("component").alias("label"))
    return reindex_labels(labels) if sort_clusters else labels


def cut_straight(dendrogram: DataFrame, n: int, n_clusters: int | None = None, threshold: float | None = None, sort_clusters: bool = True) -> DataFrame:
    """(id, label): merges below the height that leaves n_clusters (2 where neither is given), or below the threshold."""
    k = n_clusters or (2 if threshold is None else n)
    # the height of rank n - k from below; the k - 1 highest are what a request for k clusters ranks
    cut = dendrogram.orderBy(F.desc("height")).limit(k - 1).agg(F.min("height")).first()[0] if k < n else dendrogram.agg(F.min("height")).first()[0]
    cut = float("inf") if cut is None else cut
    cut = cut if threshold is None else max(cut, threshold)
    return _forest_labels(dendrogram.where(F.col("height") < cut), n, sort_clusters)


def cut_balanced(dendrogram: DataFrame, n: int, max_cluster_size: int = 20, sort_clusters: bool = True) -> DataFrame:
    """(id, label): the largest clusters of at most max_cluster_size leaves; sizes grow upwards, so merges below fit too."""
    return _forest_labels(dendrogram.where(F.col("size") <= max_cluster_size), n, sort_clusters)


def aggregate_dendrogram(dendrogram: DataFrame, n: int, n_clusters: int = 2) -> DataFrame:
    """The last n_clusters - 1 merges as a dendrogram over n_clusters leaves, numbered in the order of their old ids."""
    first = n - n_clusters
    top = dendrogram.where(F.col("step") >= first)
    leaves = _parents(top, n).where(F.col("child") < n + first).select("child")
    order = [r["child"] for r in leaves.orderBy("child").limit(n_clusters).collect()]  # n_clusters ids, an argument
    place = F.create_map(*[F.lit(x) for pair in ((c, i) for i, c in enumerate(order)) for x in pair])
    name = lambda c: F.coalesce(place[F.col(c).cast("bigint")], F.col(c).cast("bigint") - n - first + n_clusters)
    return top.select((F.col("step") - first).alias("step"), name("left").cast("bigint").alias("left"), name("right").cast("bigint").alias("right"), "height", "size")


def _node_weights(graph: Graph, weights: str) -> DataFrame:
    """(id, w_out, w_in), each summing to 1: alike for all nodes, or by the edges' weights."""
    if weights == "uniform":
        return graph.nodes.select("id", F.lit(1.0 / graph.n).alias("w_out"), F.lit(1.0 / graph.n).alias("w_in"))
    out, into = (graph.edges.groupBy(F.col(c).alias("id")).agg(F.sum("weight").alias(w)) for c, w in (("src", "w_out"), ("dst", "w_in")))
    total = graph.edges.agg(F.sum("weight").alias("total"))
    told = graph.nodes.join(out, "id", "left").join(into, "id", "left").na.fill(0.0).crossJoin(F.broadcast(total))  # one row
    return told.select("id", (F.col("w_out") / F.col("total")).alias("w_out"), (F.col("w_in") / F.col("total")).alias("w_in"))


def _cluster_weights(dendrogram: DataFrame, n: int, leaves: DataFrame) -> DataFrame:
    """(id, w_out, w_in) of leaves and clusters; each round makes the clusters whose both parts are known."""
    known, new = leaves, leaves
    left = settled(_parents(dendrogram, n))
    waiting = settled(left.where("false").select("parent", F.lit(0.0).alias("w_out"), F.lit(0.0).alias("w_in"), F.lit(0).alias("parts")))
    while True:
        arrived = new.join(left, F.col("id") == F.col("child")).select("parent", "w_out", "w_in", F.lit(1).alias("parts"))
        both = settled(waiting.unionByName(arrived).groupBy("parent").agg(F.sum("w_out").alias("w_out"), F.sum("w_in").alias("w_in"), F.sum("parts").cast("int").alias("parts")))
        new = both.where("parts = 2").select(F.col("parent").alias("id"), "w_out", "w_in")
        waiting = both.where("parts < 2")
        if new.isEmpty():
            return known
        known = settled(known.unionByName(new))


def meeting_steps(graph: Graph, dendrogram: DataFrame, n: int) -> DataFrame:
    """(step, weight): the edges' weights by the merge that first holds both ends; a self-loop's is its leaf's first.

    A parent's id exceeds its children's, so the end with the smaller id climbs until both are one.
    """
    up = settled(_parents(dendrogram, n))
    loops = graph.edges.where("src = dst").join(up, F.col("src") == F.col("child")).select(F.col("parent").alias("at"), "weight")
    met = [settled(loops)]
    front = settled(graph.edges.where("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight")))
    while not front.isEmpty():
        moved = front.join(up, F.col("a") == F.col("child")).select(F.least("parent", "b").alias("a"), F.greatest("parent", "b").alias("b"), "weight")
        moved = settled(moved.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
        met.append(moved.where("a = b").select(F.col("a").alias("at"), "weight"))
        front = moved.where("a != b")
    return reduce(DataFrame.unionByName, met).groupBy((F.col("at") - n).alias("step")).agg(F.sum("weight").alias("weight"))


def sampling_distributions(graph: Graph, dendrogram: DataFrame, weights: str = "uniform") -> DataFrame:
    """(step, edge_sampling, node_sampling, cluster_weight) of every merge."""
    n = graph.n
    total = graph.edges.agg(F.sum("weight").alias("total"))
    w = settled(_cluster_weights(dendrogram, n, _node_weights(graph, weights)))
    a, b = (w.select(F.col("id").alias(side), F.col("w_out").alias(f"{side}_out"), F.col("w_in").alias(f"{side}_in")) for side in ("left", "right"))
    own = lambda s: F.when(F.col(s) < n, F.col(f"{s}_out") * F.col(f"{s}_in")).otherwise(0.0)
    nodes = F.col("left_out") * F.col("right_in") + F.col("right_out") * F.col("left_in") + own("left") + own("right")
    size = (F.col("left_out") + F.col("right_out") + F.col("left_in") + F.col("right_in")) / 2
    merges = dendrogram.select("step", F.col("left").cast("bigint").alias("left"), F.col("right").cast("bigint").alias("right"))
    told = merges.join(a, "left").join(b, "right").select("step", nodes.alias("node_sampling"), size.alias("cluster_weight"))
    told = told.join(meeting_steps(graph, dendrogram, n), "step", "left").crossJoin(F.broadcast(total))  # one row
    return told.select("step", (F.coalesce("weight", F.lit(0.0)) / F.col("total")).alias("edge_sampling"), "node_sampling", "cluster_weight")


def dasgupta_cost(graph: Graph, dendrogram: DataFrame, weights: str = "uniform", normalized: bool = False) -> float:
    cost = sampling_distributions(graph, dendrogram, weights).agg(F.sum(F.col("edge_sampling") * F.col("cluster_weight"))).first()[0]
    if normalized:
        return cost
    return cost * (graph.edges.agg(F.sum("weight")).first()[0] if weights == "degree" else graph.n)


def dasgupta_score(graph: Graph, dendrogram: DataFrame, weights: str = "uniform") -> float:
    return 1 - dasgupta_cost(graph, dendrogram, weights, normalized=True)


def tree_sampling_divergence(graph: Graph, dendrogram: DataFrame, weights: str = "degree", normalized: bool = True) -> float:
    """Divergence of edges from pairs of nodes over the merges, over their mutual information if normalised."""
    told = sampling_distributions(graph, dendrogram, weights).where("edge_sampling > 0")
    score = told.agg(F.sum(F.col("edge_sampling") * F.log(F.col("edge_sampling") / F.col("node_sampling")))).first()[0]
    if not normalized:
        return score
    w = _node_weights(graph, weights)
    total = graph.edges.agg(F.sum("weight").alias("total"))
    pairs = graph.edges.join(w.select(F.col("id").alias("src"), "w_out"), "src").join(w.select(F.col("id").alias("dst"), "w_in"), "dst").crossJoin(F.broadcast(total))  # one row
    p = F.col("weight") / F.col("total")
    known = pairs.agg(F.sum(p * F.log(p / F.col("w_out") / F.col("w_in")))).first()[0]
    return score / known if known > 0 else score
