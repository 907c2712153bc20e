"""Nearest neighbours: classification by them, links to them; and clusters around centres."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, bipartite2undirected, directed2undirected, get_adjacency
from .checks import check_labels, check_n_neighbors
from .classifiers import pagerank_classifier
from .learning import modularity
from .linalg import columns_of
from .loops import settled
from .ranking import pagerank

Embedding = Callable[[Graph], DataFrame]


def unit_rows(graph: Graph, embedding: Embedding | None = None) -> DataFrame:
    """(id, at, value): the nodes' vectors, of length 1, by coordinate; the rows of the adjacency where no embedding is given."""
    if embedding is None:
        long = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("at"), F.col("weight").alias("value"))
    else:
        block = embedding(graph)
        long = block.select("id", F.posexplode(F.array(*[F.col(c) for c in columns_of(block)])).alias("at", "value"))
    norm = long.groupBy("id").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm")).where("norm > 0")
    return long.join(norm, "id").select("id", "at", (F.col("value") / F.col("norm")).alias("value"))


def _nearest(queries: DataFrame, others: DataFrame, k: int, threshold: float | None = None, zero: DataFrame | None = None) -> DataFrame:
    """(id, other, similarity): the k most similar of others, ties to the smaller id; pairs without a shared coordinate have 0."""
    mine = others.select(F.col("id").alias("other"), "at", F.col("value").alias("v"))
    told = queries.join(mine, "at").groupBy("id", "other").agg(F.sum(F.col("value") * F.col("v")).alias("similarity"))
    if threshold is not None:
        told = told.where(F.round("similarity", 12) >= threshold)
    order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "other")
    return told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def nn_classifier(graph: Graph, labels: DataFrame, n_neighbors: int = 3, embedding: Embedding | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, label) and (id, label, prob): the votes of the nearest labelled nodes; labelled ones keep theirs.

    A node that resembles no labelled one has no vote: label -1.
    """
    square = get_adjacency(graph, force_bipartite=graph.bipartite)
    known = settled(labels.where("label >= 0").select("id", F.col("label").cast("bigint").alias("label")))
    check_labels(known)
    k = check_n_neighbors(n_neighbors, known.count())
    vectors = settled(unit_rows(square, embedding))
    seeds = vectors.join(known.select("id"), "id", "left_semi")
    rest = vectors.join(known.select("id"), "id", "left_anti")
    votes = _nearest(rest, seeds, k).join(known.select(F.col("id").alias("other"), "label"), "other")
    probs = votes.groupBy("id", "label").agg((F.count("*") / k).alias("prob")).unionByName(known.withColumn("prob", F.lit(1.0)))
    probs = settled(probs)
    best = probs.groupBy("id").agg(F.max_by("label", F.struct("prob", -F.col("label"))).alias("label"))
    return square.nodes.join(best, "id", "left").select("id", F.coalesce("label", F.lit(-1).cast("bigint")).alias("label")), probs


def nn_linker(graph: Graph, n_neighbors: int = 10, threshold: float = 0, embedding: Embedding | None = None, index: list[int] | DataFrame | None = None) -> DataFrame:
    """(src, dst, similarity): for each row, or each in index, the most similar nodes, itself among them; of a bipartite graph, columns.

    Without an embedding rows are compared by their own entries, and a bipartite graph's by those of the block graph.
    """
    square = bipartite2undirected(graph) if graph.bipartite else graph
    vectors = settled(unit_rows(square, embedding))
    asked = vectors if not graph.bipartite else vectors.where(F.col("id") < graph.n_row)
    if index is not None:
        rows = index if isinstance(index, DataFrame) else graph.edges.sparkSession.createDataFrame([(int(i),) for i in index], "id bigint")
        asked = asked.join(rows.select("id"), "id", "left_semi")
    others = vectors if not graph.bipartite else vectors.where(F.col("id") >= graph.n_row)
    told = _nearest(asked, others, n_neighbors, threshold)
    shift = graph.n_row if graph.bipartite else 0
    return told.select(F.col("id").alias("src"), (F.col("other") - shift).alias("dst"), "similarity")


def k_centers(graph: Graph, n_clusters: int, directed: bool = False, center_position: str = "row", n_init: int = 5, max_iter: int = 20, force_bipartite: bool = False, random_state: int = 42) -> tuple[DataFrame, list[int]]:
    """(id, label) and the centres: each node joins the centre whose PageRank reaches it best, centres move to their cluster's best node
    until they stay, and of n_init beginnings the clusters of the highest modularity are kept.

    A beginning picks centres one after the other, more likely where the PageRank of those before is low.
    """
    if n_clusters < 2 or n_init < 1:
        raise ValueError("two clusters and one beginning at least are needed")
    if center_position not in ("row", "col", "both"):
        raise ValueError(f"no such position: {center_position}")
    graph = directed2undirected(graph) if directed else graph
    bipartite = graph.bipartite or force_bipartite
    square = get_adjacency(graph, force_bipartite=force_bipartite)
    square = Graph(settled(square.edges), square.n, square.n)
    spark, rng = square.edges.sparkSession, random.Random(random_state)
    low, high = (0, square.n) if not bipartite or center_position == "both" else (0, graph.n_row) if center_position == "row" else (graph.n_row, square.n)
    if n_clusters > high - low:
        raise ValueError("there are fewer places for centres than clusters")
    places = F.col("id").between(low, high - 1)
    seeds = lambda ids: spark.createDataFrame([(i, 1.0) for i in ids], "id bigint, value double")
    best = None
    for _ in range(n_init):
        centers = [rng.randrange(low, high)]
        while len(centers) < n_clusters:  # weighted choice of one row: the smallest of exponential numbers
            far = pagerank(square, seeds=seeds(centers)).where(places & ~F.col("id").isin(centers))
            noise = -F.log((F.pmod(F.xxhash64("id", F.lit(rng.randrange(1 << 30))), F.lit(1 << 40)) + 1) / float(1 << 40))
            centers.append(far.orderBy((F.col("score") > 0).cast("int"), noise * F.col("score"), noise, "id").first()["id"])
        for _ in range(max_iter):
            labels = settled(pagerank_classifier(square, spark.createDataFrame(list(zip(centers, range(n_clusters))), "id bigint, label bigint")).select("id", "label"))
            moved = []
            for c in range(n_clusters):  # n_clusters is an argument
                mine = labels.where((F.col("label") == c) & places)
                scores = pagerank(square, seeds=mine.select("id", F.lit(1.0).alias("value")))
                top = scores.join(mine.select("id"), "id", "left_semi").orderBy(F.desc(F.round("score", 12)), "id").first()
                moved.append(top["id"] if top else centers[c])
            if moved == centers:
                break
            centers = moved
        score = modularity(square, labels).first()["modularity"]
        if best is None or score > best[0]:
            best = (score, labels, centers)
    return best[1], best[2]
