"""Embeddings: tables (id, v0, v1, ...), one row a node."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, get_adjacency
from .checks import check_n_components, check_nonnegative
from .communities import louvain, membership_probs
from .linalg import EigSolver, Polynome, SparseLR, SVDSolver, _frame, columns_of, dot_columns, laplacian_operator, matrix, normalizer, ones, pseudo_inverse, regularizer
from .loops import settled
from .topology import is_connected


def l2_normalized(block: DataFrame) -> DataFrame:
    """Rows of length 1; null rows stay null."""
    names = columns_of(block)
    norm = F.sqrt(sum((F.col(c) ** 2 for c in names), F.lit(0.0)))
    return block.select("id", *[F.when(norm > 0, F.col(c) / norm).otherwise(0.0).alias(c) for c in names])


def _times(block: DataFrame, scale: DataFrame, powers) -> DataFrame:
    names = columns_of(block)
    told = block.join(scale.withColumnRenamed("value", "s"), "id", "left")
    return told.select("id", *[(F.col(c) * F.coalesce("s", F.lit(0.0)) * float(p)).alias(c) for c, p in zip(names, powers)])


@dataclass
class Factors:
    """What a singular value decomposition found."""

    embedding_row: DataFrame
    embedding_col: DataFrame
    singular_values: np.ndarray
    vectors_left: DataFrame
    vectors_right: DataFrame
    weights_col: DataFrame | None = None
    how: dict | None = None

    def predict(self, rows: DataFrame) -> DataFrame:
        """The embedding of new rows (src, dst, weight), as the old ones' were made."""
        check_nonnegative(rows)
        how = self.how
        n_col, regularization = how["n_col"], how["regularization"] or 0
        ids = rows.select(F.col("src").alias("id")).distinct()
        total = rows.groupBy(F.col("src").alias("id")).agg((F.sum("weight") + regularization).alias("value"))
        by_row, by_col = pseudo_inverse(total, how["factor_row"]), pseudo_inverse(self.weights_col, how["factor_col"])
        right = settled(_times(self.vectors_right, by_col, np.ones(len(self.singular_values))))
        names = columns_of(right)
        extra = right.agg(*[F.sum(c) for c in names]).first() if regularization else [0.0] * len(names)
        told = ids.join(dot_columns(rows, right), "id", "left").na.fill(0.0)
        told = told.select("id", *[(F.col(c) + regularization / n_col * (e or 0.0)).alias(c) for c, e in zip(names, extra)])
        twice = by_row.select("id", (F.col("value") ** 2).alias("value"))
        told = _times(told, twice, np.power(self.singular_values, -how["factor_singular"]))
        return l2_normalized(told) if how["normalized"] else told


def gsvd(graph: Graph, n_components: int = 2, regularization: float | None = None, factor_row: float = 0.5, factor_col: float = 0.5, factor_singular: float = 0.0, normalized: bool = True, solver: SVDSolver | None = None) -> Factors:
    """Singular vectors of rows and columns divided by powers of their sums, times powers of the singular values."""
    k = check_n_components(n_components, min(graph.n_row, graph.n_col) - 1)
    told = regularizer(graph, regularization or 0)
    weights_row, weights_col = settled(told.sum(axis=1)), settled(told.sum(axis=0))
    by_row, by_col = settled(pseudo_inverse(weights_row, factor_row)), settled(pseudo_inverse(weights_col, factor_col))
    scaled = told.scaled(by_row, by_col)
    scaled = SparseLR(settled(scaled.edges), scaled.n_row, scaled.n_col, scaled.low_rank)
    found = (solver or SVDSolver()).fit(scaled, k)
    s = found.singular_values_
    row = _times(found.singular_vectors_left_, by_row, np.power(s, 1 - factor_singular))
    col = _times(found.singular_vectors_right_, by_col, np.power(s, factor_singular))
    if normalized:
        row, col = l2_normalized(row), l2_normalized(col)
    how = {"n_col": graph.n_col, "regularization": regularization, "factor_row": factor_row, "factor_col": factor_col, "factor_singular": factor_singular, "normalized": normalized}
    return Factors(row, col, s, found.singular_vectors_left_, found.singular_vectors_right_, weights_col, how)


def svd(graph: Graph, n_components: int = 2, regularization: float | None = None, factor_singular: float = 0.0, normalized: bool = False, solver: SVDSolver | None = None) -> Factors:
    """gsvd() of the matrix as it stands."""
    return gsvd(graph, n_components, regularization, 0.0, 0.0, factor_singular, normalized, solver)


def pca(graph: Graph, n_components: int = 2, solver: SVDSolver | None = None) -> Factors:
    """Singular vectors of the matrix less its columns' means."""
    means = matrix(graph).sum(axis=0).select("id", (-F.col("value") / graph.n_row).alias("value"))
    centred = SparseLR(settled(graph.edges), graph.n_row, graph.n_col, [(ones(graph.edges.sparkSession, graph.n_row), settled(means))])
    found = (solver or SVDSolver()).fit(centred, n_components)
    return Factors(found.singular_vectors_left_, found.singular_vectors_right_, found.singular_values_, found.singular_vectors_left_, found.singular_vectors_right_)


def _regularization(regularization: float, graph: Graph) -> float:
    """A negative one counts only where the graph isn't strongly connected."""
    if regularization >= 0:
        return regularization
    return 0.0 if is_connected(graph, strong=True) else -regularization


@dataclass
class Spectrum:
    embedding: DataFrame
    eigenvalues: np.ndarray
    eigenvectors: DataFrame


def spectral(graph: Graph, n_components: int = 2, decomposition: str = "rw", regularization: float = -1, normalized: bool = True, force_bipartite: bool = False, solver: EigSolver | None = None) -> Spectrum:
    """Eigenvectors of the random walk ('rw', eigenvalues from 1 down) or of the Laplacian ('laplacian', from 0 up), the trivial one
    left out.  A directed graph is taken as bipartite: rows, then columns."""
    if decomposition not in ("rw", "laplacian"):
        raise ValueError(f"no such decomposition: {decomposition}")
    square = get_adjacency(graph, allow_directed=False, force_bipartite=force_bipartite)
    square = Graph(settled(square.edges), square.n, square.n)
    k = check_n_components(n_components, square.n - 2)
    lap, scale = laplacian_operator(square, _regularization(regularization, square), decomposition == "rw")
    lap = SparseLR(settled(lap.edges), lap.n_row, lap.n_col, lap.low_rank)
    found = (solver or EigSolver(which="SM")).fit(lap, k + 1)
    order = np.argsort(found.eigenvalues_)[1:]
    vectors = found.eigenvectors_.select("id", *[F.col(f"v{i}").alias(f"v{j}") for j, i in enumerate(order)])
    values = found.eigenvalues_[order]
    if scale is not None:
        vectors, values = settled(_times(vectors, scale, np.ones(k))), 1 - values
    return Spectrum(l2_normalized(vectors) if normalized else vectors, values, vectors)


def random_projection(graph: Graph, n_components: int = 2, alpha: float = 0.5, n_iter: int = 3, random_walk: bool = False, regularization: float = -1, normalized: bool = True, force_bipartite: bool = False, random_state: int = 42) -> DataFrame:
    """The sum over t of (alpha M)^t Q, Q an orthonormal random block, M the regularised matrix or random walk."""
    from .linalg import orthonormal, random_block

    square = get_adjacency(graph, force_bipartite=force_bipartite)
    square = Graph(settled(square.edges), square.n, square.n)
    reg = _regularization(regularization, square)
    m = (normalizer if random_walk else regularizer)(square, reg)
    spark = graph.edges.sparkSession
    if square.n * n_components <= 1_000_000:
        start = _frame(spark, np.linalg.qr(np.random.RandomState(random_state).normal(size=(square.n, n_components)))[0])
    else:
        start = orthonormal(random_block(spark, square.n, n_components, random_state))
    told = Polynome(m, [alpha**t for t in range(n_iter + 1)]).dot(start)
    return l2_normalized(told) if normalized else told


def singleton_labels(labels: DataFrame, which: str = "remove") -> DataFrame:
    """(id, label): labels that one node alone has become -1 ('remove'), one common label ('merge'), or stay ('keep')."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    if which == "keep":
        return labels
    from ..sources.tables import numbered

    kept = numbered(sizes.where("n > 1").select(F.col("label").alias("name")))
    other = -1 if which == "remove" else kept.count()
    told = labels.join(kept.select(F.col("name").alias("label"), F.col("id").alias("new")), "label", "left")
    return told.select("id", F.coalesce("new", F.lit(other).cast("bigint")).alias("label"))


def louvain_embedding(graph: Graph, resolution: float = 1, modularity: str = "dugue", isolated_nodes: str = "remove", force_bipartite: bool = False) -> DataFrame:
    """(id, label, prob): the share of each row's weight that goes to each cluster of (column) nodes; absent pairs are 0."""
    labels = louvain(graph, resolution=resolution, modularity=modularity.lower(), sort_clusters=False, force_bipartite=force_bipartite)
    if graph.bipartite or force_bipartite:
        labels = labels.where(F.col("id") >= graph.n_row).withColumn("id", F.col("id") - graph.n_row)
    kept = settled(singleton_labels(settled(labels), isolated_nodes))
    total = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("t")).where("t != 0")
    if isolated_nodes == "keep":
        return membership_probs(graph, kept)
    told = graph.edges.join(kept.select(F.col("id").alias("dst"), "label").where("label >= 0"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
    return told.join(total, "id").select("id", "label", (F.col("w") / F.col("t")).alias("prob"))


def predict_positions(rows: DataFrame, embedding: DataFrame) -> DataFrame:
    """New rows (src, dst, weight) at the weighted mean of their neighbours' places."""
    total = rows.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("value"))
    told = dot_columns(rows, embedding)
    return _times(told, pseudo_inverse(total), np.ones(len(columns_of(embedding))))


__all__ = ["Factors", "Spectrum", "gsvd", "l2_normalized", "louvain_embedding", "pca", "predict_positions", "random_projection", "singleton_labels", "spectral", "svd"]
