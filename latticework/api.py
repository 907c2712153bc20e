"""Classes with parameters, fit and predict, over the functions of the operators.

fit() takes a Graph and gives the object back; results are tables in attributes that end with an underscore, those of rows and of columns
of a bipartite graph beside the whole.  get_params() and set_params() leave random_state and verbose aside.
"""

from __future__ import annotations

import inspect
import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph, get_adjacency
from .operators import agglomeration, centrality, classifiers, communities, embeddings, hierarchy, layouts, learning, neighbors, ranking
from .operators.checks import check_connected, check_damping_factor, check_format, check_labels, check_square
from .operators.gnn import GNNClassifier
from .operators.learning import aggregate_graph, reindex_labels
from .operators.values import Given, as_table, get_adjacency_values, split_sides


class Algorithm:
    """Parameters are the constructor's arguments, kept under their names."""

    def __init_subclass__(cls, **how):
        super().__init_subclass__(**how)
        own = cls.__init__

        def keep(self, *args, **named):
            told = inspect.signature(own).bind(self, *args, **named)
            told.apply_defaults()
            for name, value in list(told.arguments.items())[1:]:
                setattr(self, name, value)
            own(self, *args, **named)

        keep.__signature__ = inspect.signature(own)
        keep.__wrapped__ = getattr(own, "__wrapped__", own)
        if "__init__" in cls.__dict__:
            cls.__init__ = keep

    def get_params(self) -> dict:
        names = list(inspect.signature(type(self).__init__).parameters)[1:]
        return {n: getattr(self, n) for n in names if n not in ("random_state", "verbose")}

    def set_params(self, params: dict) -> Algorithm:
        for name, value in params.items():
            if name not in self.get_params():
                raise ValueError(f"no such parameter: {name}")
            setattr(self, name, value)
        return self

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params().items())})"

    def print_log(self, *told) -> None:
        if getattr(self, "verbose", False):
            logging.getLogger(type(self).__name__).info(" ".join(map(str, told)))

    def fit(self, *args, **named) -> Algorithm:
        raise NotImplementedError

    def _sides(self, graph: Graph, bipartite: bool, **tables: DataFrame) -> None:
        """name_ of the nodes, or of the rows with name_row_ and name_col_ beside it."""
        self.bipartite = bipartite
        for name, table in tables.items():
            if not bipartite:
                setattr(self, f"{name}_", table)
                continue
            rows, cols = split_sides(table, graph.n_row)
            setattr(self, f"{name}_", rows)
            setattr(self, f"{name}_row_", rows)
            setattr(self, f"{name}_col_", cols)

    def _of(self, name: str, columns: bool) -> DataFrame:
        if not hasattr(self, f"{name}_"):
            raise ValueError("call fit first")
        return getattr(self, f"{name}_col_" if columns else f"{name}_")


class BaseRanking(Algorithm):
    def predict(self, columns: bool = False) -> DataFrame:
        return self._of("scores", columns)

    def fit_predict(self, *args, **named) -> DataFrame:
        return self.fit(*args, **named).predict()


class PageRank(BaseRanking):
    def __init__(self, damping_factor: float = 0.85, solver: str = "piteration", n_iter: int = 10, tol: float = 1e-6):
        check_damping_factor(damping_factor)

    def fit(self, graph: Graph, weights: Given = None, weights_row: Given = None, weights_col: Given = None, force_bipartite: bool = False) -> PageRank:
        square, seeds, bipartite = get_adjacency_values(check_format(graph), force_bipartite=force_bipartite, values=weights, values_row=weights_row, values_col=weights_col, default_value=0, which="probs")
        told = ranking.pagerank(Graph(square.edges, square.n, square.n), self.damping_factor, self.n_iter, seeds, self.tol, self.solver)
        self._sides(graph, bipartite, scores=told)
        return self


class Katz(BaseRanking):
    def __init__(self, damping_factor: float = 0.5, path_length: int = 4):
        pass

    def fit(self, graph: Graph) -> Katz:
        self._sides(graph, graph.bipartite, scores=ranking.katz(check_format(graph), self.damping_factor, self.path_length))
        return self


class HITS(BaseRanking):
    def __init__(self, n_iter: int = 100, tol: float = 1e-12):
        pass

    def fit(self, graph: Graph) -> HITS:
        """Scores of rows are hubs', those of columns authorities'."""
        told = ranking.hits(check_format(graph), self.n_iter, self.tol)
        self.scores_ = self.scores_row_ = told.where("part = 'row'").drop("part")
        self.scores_col_ = told.where("part = 'col'").drop("part")
        return self


class Closeness(BaseRanking):
    def __init__(self, method: str = "exact", tol: float = 0.1):
        if method not in ("exact", "approximate"):
            raise ValueError(f"no such method: {method}")

    def fit(self, graph: Graph) -> Closeness:
        """approximate: scores of min(ln n / tol^2, n) nodes, chosen by a hash of their ids."""
        import math

        check_square(check_format(graph))
        check_connected(graph)
        some = None
        if self.method == "approximate":
            k = min(int(math.log(max(graph.n, 2)) / self.tol**2), graph.n)
            some = graph.nodes.orderBy(F.xxhash64("id"), "id").limit(k)
        self._sides(graph, False, scores=centrality.closeness(graph, some))
        return self


class Betweenness(BaseRanking):
    def __init__(self, normalized: bool = False):
        pass

    def fit(self, graph: Graph) -> Betweenness:
        check_square(check_format(graph))
        check_connected(graph)
        told = centrality.betweenness(graph)
        if self.normalized:
            told = told.select("id", (F.col("score") * 2 / max((graph.n - 1) * (graph.n - 2), 1)).alias("score"))
        self._sides(graph, False, scores=told)
        return self


class BaseClustering(Algorithm):
    """labels_, and by request probs_ (id, label, prob) and aggregate_, the graph between clusters."""

    def predict(self, columns: bool = False) -> DataFrame:
        return self._of("labels", columns)

    def fit_predict(self, *args, **named) -> DataFrame:
        return self.fit(*args, **named).predict()

    def predict_proba(self, columns: bool = False) -> DataFrame:
        return self._of("probs", columns)

    def fit_predict_proba(self, *args, **named) -> DataFrame:
        return self.fit(*args, **named).predict_proba()

    transform, fit_transform = predict_proba, fit_predict_proba

    def _outputs(self, graph: Graph, labels: DataFrame, bipartite: bool) -> None:
        self._sides(graph, bipartite, labels=labels)
        if not bipartite:
            if getattr(self, "return_probs", True):
                self.probs_ = communities.membership_probs(graph, labels)
            if getattr(self, "return_aggregate", True):
                self.aggregate_ = aggregate_graph(graph, labels)
            return
        if getattr(self, "return_probs", True):
            self.probs_ = self.probs_row_ = communities.membership_probs(graph, self.labels_col_)
            self.probs_col_ = communities.membership_probs(graph.transpose(), self.labels_row_)
        if getattr(self, "return_aggregate", True):
            self.aggregate_ = aggregate_graph(graph, labels_row=self.labels_row_, labels_col=self.labels_col_)


class Louvain(BaseClustering):
    _find = staticmethod(communities.louvain)

    def __init__(self, resolution: float = 1, modularity: str = "dugue", tol_optimization: float = 1e-3, tol_aggregation: float = 1e-3, n_aggregations: int = -1, shuffle_nodes: bool = False, sort_clusters: bool = True, return_probs: bool = True, return_aggregate: bool = True, random_state: int | None = None, verbose: bool = False):
        pass

    def fit(self, graph: Graph, force_bipartite: bool = False) -> Louvain:
        labels = self._find(check_format(graph), self.resolution, self.modularity.lower(), self.tol_optimization, self.tol_aggregation, self.n_aggregations, self.sort_clusters, force_bipartite)
        self._outputs(graph, labels, graph.bipartite or force_bipartite)
        return self


class Leiden(Louvain):
    _find = staticmethod(communities.leiden)


class PropagationClustering(BaseClustering):
    def __init__(self, n_iter: int = 5, weighted: bool = True, sort_clusters: bool = True, return_probs: bool = True, return_aggregate: bool = True):
        pass

    def fit(self, graph: Graph) -> PropagationClustering:
        used = graph if self.weighted else Graph(graph.edges.withColumn("weight", F.lit(1.0)), graph.n_row, graph.n_col, graph.bipartite)
        labels = classifiers.propagation_clusters(used, self.n_iter)
        self._outputs(graph, reindex_labels(labels) if self.sort_clusters else labels, graph.bipartite)
        return self


class KCenters(BaseClustering):
    def __init__(self, n_clusters: int, directed: bool = False, center_position: str = "row", n_init: int = 5, max_iter: int = 20, random_state: int = 42):
        pass

    def fit(self, graph: Graph, force_bipartite: bool = False) -> KCenters:
        labels, self.centers_ = neighbors.k_centers(graph, self.n_clusters, self.directed, self.center_position, self.n_init, self.max_iter, force_bipartite, self.random_state)
        self._outputs(graph, labels, graph.bipartite or force_bipartite)
        return self


class BaseClassifier(BaseClustering):
    """Classes instead of clusters; there is no aggregate."""

    def _seeds(self, graph: Graph, labels: Given, labels_row: Given, labels_col: Given, force_bipartite: bool = False) -> tuple[Graph, DataFrame, bool]:
        square, values, bipartite = get_adjacency_values(check_format(graph), force_bipartite=force_bipartite, values=_as_values(graph, labels), values_row=_as_values(graph, labels_row), values_col=_as_values(graph, labels_col), which="labels")
        seeds = values.where("value >= 0").select("id", F.col("value").cast("bigint").alias("label"))
        return Graph(square.edges, square.n, square.n), seeds, bipartite


def _as_values(graph: Graph, labels: Given) -> DataFrame | None:
    if isinstance(labels, DataFrame) and "label" in labels.columns:
        return labels.select("id", F.col("label").cast("double").alias("value"))
    return as_table(graph.edges.sparkSession, labels)


class PageRankClassifier(BaseClassifier):
    def __init__(self, damping_factor: float = 0.85, n_iter: int = 10):
        pass

    def fit(self, graph: Graph, labels: Given = None, labels_row: Given = None, labels_col: Given = None, force_bipartite: bool = False) -> PageRankClassifier:
        square, seeds, bipartite = self._seeds(graph, labels, labels_row, labels_col, force_bipartite)
        check_labels(seeds)
        told = classifiers.pagerank_classifier(square, seeds, self.damping_factor, self.n_iter)
        self._sides(graph, bipartite, labels=told.select("id", "label"), probs=told)
        return self


class DiffusionClassifier(BaseClassifier):
    def __init__(self, n_iter: int = 10, centering: bool = True, scale: float = 5):
        pass

    def fit(self, graph: Graph, labels: Given = None, labels_row: Given = None, labels_col: Given = None, force_bipartite: bool = False) -> DiffusionClassifier:
        square, seeds, bipartite = self._seeds(graph, labels, labels_row, labels_col, force_bipartite)
        check_labels(seeds)
        told = classifiers.diffusion_classifier(square, seeds, self.n_iter, self.scale, self.centering)
        self._sides(graph, bipartite, labels=told.select("id", "label"), probs=told)
        return self


class Propagation(BaseClassifier):
    def __init__(self, n_iter: int = -1, weighted: bool = True):
        pass

    def fit(self, graph: Graph, labels: Given = None, labels_row: Given = None, labels_col: Given = None) -> Propagation:
        square, seeds, bipartite = self._seeds(graph, labels, labels_row, labels_col)
        told = classifiers.propagation(square, seeds, self.n_iter, self.weighted)
        self._sides(graph, bipartite, labels=told, probs=communities.membership_probs(square, told.where("label >= 0")))
        return self


class NNClassifier(BaseClassifier):
    def __init__(self, n_neighbors: int = 3, embedding=None):
        pass

    def fit(self, graph: Graph, labels: Given = None, labels_row: Given = None, labels_col: Given = None) -> NNClassifier:
        square, seeds, bipartite = self._seeds(graph, labels, labels_row, labels_col)
        told, probs = neighbors.nn_classifier(square, seeds, self.n_neighbors, self.embedding)
        self._sides(graph, bipartite, labels=told, probs=probs)
        return self


class NNLinker(Algorithm):
    def __init__(self, n_neighbors: int = 10, threshold: float = 0, embedding=None):
        pass

    def fit(self, graph: Graph, index=None) -> NNLinker:
        self.links_ = neighbors.nn_linker(graph, self.n_neighbors, self.threshold, self.embedding, index)
        return self

    def predict(self) -> DataFrame:
        return self._of("links", False)

    def fit_predict(self, *args, **named) -> DataFrame:
        return self.fit(*args, **named).predict()


class BaseRegressor(Algorithm):
    def predict(self, columns: bool = False) -> DataFrame:
        return self._of("values", columns)

    def fit_predict(self, *args, **named) -> DataFrame:
        return self.fit(*args, **named).predict()

    def _fit(self, how, graph: Graph, values: Given, values_row: Given, values_col: Given, init: float | None, force_bipartite: bool, **more) -> BaseRegressor:
        square, told, bipartite = get_adjacency_values(check_format(graph), force_bipartite=force_bipartite, values=values, values_row=values_row, values_col=values_col)
        self._sides(graph, bipartite, values=how(Graph(square.edges, square.n, square.n), told, init=init, **more))
        return self


class Diffusion(BaseRegressor):
    def __init__(self, n_iter: int = 3, damping_factor: float = 0.5):
        pass

    def fit(self, graph: Graph, values: Given = None, values_row: Given = None, values_col: Given = None, init: float | None = None, force_bipartite: bool = False) -> Diffusion:
        return self._fit(learning.diffusion, graph, values, values_row, values_col, init, force_bipartite, n_iter=self.n_iter, damping_factor=self.damping_factor)


class Dirichlet(BaseRegressor):
    def __init__(self, n_iter: int = 10):
        pass

    def fit(self, graph: Graph, values: Given = None, values_row: Given = None, values_col: Given = None, init: float | None = None, force_bipartite: bool = False) -> Dirichlet:
        return self._fit(learning.dirichlet, graph, values, values_row, values_col, init, force_bipartite, n_iter=self.n_iter)


class BaseHierarchy(Algorithm):
    def predict(self, columns: bool = False) -> DataFrame:
        return self._of("dendrogram", columns)

    transform = predict

    def fit_predict(self, *args, **named) -> DataFrame:
        return self.fit(*args, **named).predict()

    fit_transform = fit_predict

    def _keep(self, graph: Graph, dendrogram: DataFrame, bipartite: bool) -> BaseHierarchy:
        self.bipartite, self.dendrogram_ = bipartite, dendrogram
        if bipartite:
            self.dendrogram_full_ = dendrogram
            self.dendrogram_row_, self.dendrogram_col_ = agglomeration.split_dendrogram(dendrogram, graph.n_row, graph.n_col)
            self.dendrogram_ = self.dendrogram_row_
        return self


class Paris(BaseHierarchy):
    def __init__(self, weights: str = "degree", reorder: bool = True):
        pass

    def fit(self, graph: Graph, force_bipartite: bool = False) -> Paris:
        return self._keep(graph, agglomeration.paris(graph, self.weights, self.reorder, force_bipartite), graph.bipartite or force_bipartite)


class LouvainIteration(BaseHierarchy):
    def __init__(self, depth: int = 3, resolution: float = 1, tol_optimization: float = 1e-3, tol_aggregation: float = 1e-3, n_aggregations: int = -1):
        pass

    def fit(self, graph: Graph, force_bipartite: bool = False) -> LouvainIteration:
        return self._keep(graph, agglomeration.louvain_iteration(graph, self.depth, self.resolution, self.tol_optimization, self.tol_aggregation, self.n_aggregations, force_bipartite), graph.bipartite or force_bipartite)


class LouvainHierarchy(BaseHierarchy):
    def __init__(self, resolution: float = 1, tol_optimization: float = 1e-3, tol_aggregation: float = 1e-3):
        pass

    def fit(self, graph: Graph, force_bipartite: bool = False) -> LouvainHierarchy:
        return self._keep(graph, agglomeration.louvain_hierarchy(graph, self.resolution, self.tol_optimization, self.tol_aggregation, force_bipartite), graph.bipartite or force_bipartite)


class BaseEmbedding(Algorithm):
    def transform(self, columns: bool = False) -> DataFrame:
        return self._of("embedding", columns)

    def fit_transform(self, *args, **named) -> DataFrame:
        return self.fit(*args, **named).transform()


class GSVD(BaseEmbedding):
    def __init__(self, n_components: int = 2, regularization: float | None = None, factor_row: float = 0.5, factor_col: float = 0.5, factor_singular: float = 0.0, normalized: bool = True, solver=None):
        pass

    def _find(self, graph: Graph) -> embeddings.Factors:
        return embeddings.gsvd(graph, self.n_components, self.regularization, self.factor_row, self.factor_col, self.factor_singular, self.normalized, self.solver)

    def fit(self, graph: Graph) -> GSVD:
        self._factors = found = self._find(check_format(graph))
        self.embedding_ = self.embedding_row_ = found.embedding_row
        self.embedding_col_, self.singular_values_ = found.embedding_col, found.singular_values
        self.singular_vectors_left_, self.singular_vectors_right_, self.weights_col_ = found.vectors_left, found.vectors_right, found.weights_col
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self._factors.predict(rows)


class SVD(GSVD):
    def __init__(self, n_components: int = 2, regularization: float | None = None, factor_singular: float = 0.0, normalized: bool = False, solver=None):
        pass

    def _find(self, graph: Graph) -> embeddings.Factors:
        return embeddings.svd(graph, self.n_components, self.regularization, self.factor_singular, self.normalized, self.solver)


class PCA(GSVD):
    def __init__(self, n_components: int = 2, normalized: bool = False, solver=None):
        pass

    def _find(self, graph: Graph) -> embeddings.Factors:
        return embeddings.pca(graph, self.n_components, self.solver)


class Spectral(BaseEmbedding):
    def __init__(self, n_components: int = 2, decomposition: str = "rw", regularization: float = -1, normalized: bool = True):
        pass

    def fit(self, graph: Graph, force_bipartite: bool = False) -> Spectral:
        square = get_adjacency(check_format(graph), allow_directed=False, force_bipartite=force_bipartite)
        found = embeddings.spectral(graph, self.n_components, self.decomposition, self.regularization, self.normalized, force_bipartite)
        self.eigenvalues_, self.eigenvectors_ = found.eigenvalues, found.eigenvectors
        self._sides(graph, square.n != graph.n_row, embedding=found.embedding)
        return self


class RandomProjection(BaseEmbedding):
    def __init__(self, n_components: int = 2, alpha: float = 0.5, n_iter: int = 3, random_walk: bool = False, regularization: float = -1, normalized: bool = True, random_state: int = 42):
        pass

    def fit(self, graph: Graph, force_bipartite: bool = False) -> RandomProjection:
        told = embeddings.random_projection(check_format(graph), self.n_components, self.alpha, self.n_iter, self.random_walk, self.regularization, self.normalized, force_bipartite, self.random_state)
        self._sides(graph, graph.bipartite or force_bipartite, embedding=told)
        return self


class LouvainEmbedding(BaseEmbedding):
    """The embedding is (id, label, prob): a dimension a cluster, absent pairs being 0."""

    def __init__(self, resolution: float = 1, modularity: str = "dugue", isolated_nodes: str = "remove"):
        pass

    def fit(self, graph: Graph, force_bipartite: bool = False) -> LouvainEmbedding:
        self.embedding_ = embeddings.louvain_embedding(check_format(graph), self.resolution, self.modularity, self.isolated_nodes, force_bipartite)
        return self


class Spring(BaseEmbedding):
    def __init__(self, n_components: int = 2, strength: float | None = None, n_iter: int = 50, tol: float = 1e-4, approx_radius: float = -1, position_init: str = "random", random_state: int = 42):
        pass

    def fit(self, graph: Graph, position_init=None, n_iter: int | None = None) -> Spring:
        self.embedding_ = layouts.spring(graph, self.n_components, self.strength, n_iter or self.n_iter, self.tol, self.approx_radius, self.position_init if position_init is None else position_init, self.random_state)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return embeddings.predict_positions(rows, self.transform())


class ForceAtlas(BaseEmbedding):
    def __init__(self, n_components: int = 2, n_iter: int = 50, approx_radius: float = -1, lin_log: bool = False, gravity_factor: float = 0.01, repulsive_factor: float = 0.1, speed: float = 0.1, speed_max: float = 10, random_state: int = 42):
        pass

    def fit(self, graph: Graph, pos_init=None, n_iter: int | None = None) -> ForceAtlas:
        self.embedding_ = layouts.force_atlas(graph, self.n_components, n_iter or self.n_iter, self.approx_radius, self.lin_log, self.gravity_factor, self.repulsive_factor, self.speed, self.speed_max, pos_init, self.random_state)
        return self


__all__ = [n for n, c in list(globals().items()) if isinstance(c, type) and issubclass(c, Algorithm)] + ["GNNClassifier", "hierarchy"]
