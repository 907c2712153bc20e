"""Paths and parts of graphs with rows and columns, in the forms that take either kind of graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, bipartite2undirected, from_biadjacency, is_symmetric
from ..sources.tables import numbered
from . import topology
from .loops import settled
from .values import split_sides, submatrix

Source = int | list[int] | None


def _ids(source: Source) -> list[int]:
    return [] if source is None else [source] if isinstance(source, int) else list(source)


def get_distances(graph: Graph, source: Source = None, source_row: Source = None, source_col: Source = None, transpose: bool = False, force_bipartite: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(id, distance) in hops from the nearest source, -1 where none leads; against the edges with transpose.

    A bipartite graph, or one that is forced to be, takes sources among rows (source is one) and columns, and gives both sides.
    """
    if source is not None and source_row is not None:
        raise ValueError("give source or source_row")
    if source is None and source_row is None and source_col is None:
        raise ValueError("a source is needed")
    if graph.bipartite or force_bipartite or source_row is not None or source_col is not None:
        rows = _ids(source if source is not None else source_row)
        told = topology.distances(bipartite2undirected(graph), rows + [graph.n_row + c for c in _ids(source_col)])
        return split_sides(told, graph.n_row)
    return topology.distances(graph.transpose() if transpose else graph, _ids(source))


def get_dag(graph: Graph, source: Source = None, order: DataFrame | None = None) -> Graph:
    """The edges that lead from a smaller to a larger place: of order(id, value), of the distance from source, or of the id.  Nodes
    with a negative place have none."""
    edges = graph.edges.where("weight != 0")
    if order is None and source is None:
        return Graph(edges.where("src < dst"), graph.n_row, graph.n_col)
    place = order if order is not None else topology.distances(graph, _ids(source)).withColumnRenamed("distance", "value")
    place = settled(place.select("id", "value"))
    a, b = place.select(F.col("id").alias("src"), F.col("value").alias("a")), place.select(F.col("id").alias("dst"), F.col("value").alias("b"))
    return Graph(edges.join(a, "src").join(b, "dst").where("a >= 0 and a < b").select("src", "dst", "weight"), graph.n_row, graph.n_col)


def get_shortest_path(graph: Graph, source: Source = None, source_row: Source = None, source_col: Source = None, force_bipartite: bool = False) -> Graph:
    """The edges of all shortest paths from the sources; of the block graph for a bipartite one."""
    if graph.bipartite or force_bipartite or source_row is not None or source_col is not None:
        block = bipartite2undirected(graph)
        rows = _ids(source if source is not None else source_row)
        return get_dag(block, rows + [graph.n_row + c for c in _ids(source_col)])
    return get_dag(graph, source)


def breadth_first_search(graph: Graph, source: int) -> DataFrame:
    """(id, distance) of the nodes that source leads to, nearest first, then by id."""
    return get_distances(graph, source).where("distance >= 0").orderBy("distance", "id")


def get_connected_components(graph: Graph, connection: str = "weak", force_bipartite: bool = False) -> DataFrame:
    """(id, label): parts numbered from 0 in the order of their smallest node; rows, then columns, for a bipartite graph."""
    if connection not in ("weak", "strong"):
        raise ValueError(f"connection is 'weak' or 'strong', not {connection!r}")
    square = bipartite2undirected(graph) if graph.bipartite or force_bipartite else graph
    part = settled(topology.strong_components(square) if connection == "strong" else topology.connected_components(square))
    least = part.groupBy("component").agg(F.min("id").alias("name"))
    place = numbered(least.select("name")).join(least, "name").select("component", F.col("id").alias("label"))
    return part.join(place, "component").select("id", "label")


def get_largest_connected_component(graph: Graph, connection: str = "weak", force_bipartite: bool = False) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph of the part with the most nodes, the first of equals, and (id, old) of its rows and columns."""
    bipartite = graph.bipartite or force_bipartite
    labels = settled(get_connected_components(graph, connection, force_bipartite))
    best = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first()["label"]
    kept = labels.where(F.col("label") == best).select("id")
    if not bipartite:
        return submatrix(graph, kept)
    rows, cols = split_sides(kept, graph.n_row)
    part, r, c = submatrix(graph, rows, cols)
    return from_biadjacency(part.edges, part.n_row, part.n_col), r, c


def split_bipartite(graph: Graph) -> tuple[Graph, DataFrame, DataFrame] | None:
    """(biadjacency, rows, columns) of an undirected graph without an odd cycle, else None.  The smallest node of each part is a row.

    In the double cover of such a graph a part falls into two; a node's copy that lies with its part's smallest node tells its side.
    """
    if not is_symmetric(graph):
        raise ValueError("the graph has to be undirected")
    edges = graph.edges.where("weight != 0").select("src", "dst")
    cover = edges.select((2 * F.col("src")).alias("src"), (2 * F.col("dst") + 1).alias("dst")).unionByName(edges.select((2 * F.col("src") + 1).alias("src"), (2 * F.col("dst")).alias("dst")))
    part = settled(topology.connected_components(Graph(cover.withColumn("weight", F.lit(1.0)), 2 * graph.n_row, 2 * graph.n_row)))
    both = part.groupBy(F.floor(F.col("id") / 2).alias("node")).agg(F.min(F.when(F.col("id") % 2 == 0, F.col("component"))).alias("even"), F.min(F.when(F.col("id") % 2 == 1, F.col("component"))).alias("odd"))
    both = settled(both)
    if not both.where("even = odd").isEmpty():
        return None
    # of a part's two components the one with the smaller name holds the smallest node's even copy
    rows, cols = both.where("even < odd").select(F.col("node").alias("id")), both.where("even > odd").select(F.col("node").alias("id"))
    told, r, c = submatrix(graph, rows, cols)
    return from_biadjacency(told.edges, told.n_row, told.n_col), r, c


def is_acyclic(graph: Graph, directed: bool | None = None) -> bool:
    """Whether there is no cycle; in an undirected graph, a forest has as many parts as nodes less edges."""
    if not graph.edges.where("src = dst and weight != 0").isEmpty():
        return False
    directed = not is_symmetric(graph) if directed is None else directed
    if directed:
        return topology.is_acyclic(graph)
    parts = topology.connected_components(graph).select("component").distinct().count()
    return parts == graph.n_row - graph.edges.where("weight != 0 and src < dst").count()
