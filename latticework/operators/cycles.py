"""Cycles of a graph: listing them, breaking them, and the colour test of isomorphism."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, is_symmetric
from .local import MOST_EDGES, as_rows, collected
from .loops import settled
from .topology import color_refinement, connected_components, strong_components


def _linked(graph: Graph, most: int) -> tuple[list[list[int]], list[int]]:
    """Successors of each node in order, self-loops left out, and the nodes that have one."""
    local = collected(graph, most)
    near: list[list[int]] = [[] for _ in range(local.n)]
    loops = []
    for i, j, w in zip(local.src.tolist(), local.dst.tolist(), local.weight.tolist()):
        if w and i == j:
            loops.append(i)
        elif w:
            near[i].append(j)
    return near, loops


def get_cycles(graph: Graph, directed: bool | None = None, most: int = MOST_EDGES) -> list[list[int]]:
    """All simple cycles, each from its smallest node on; of undirected cycles over the same nodes, one.

    Spark finds the components that can hold a cycle, and only their edges are followed in one process: the number of cycles may
    grow exponentially with a component.
    """
    directed = not is_symmetric(graph) if directed is None else directed
    edges = settled(graph.edges.where("weight != 0").select("src", "dst", "weight"))
    part = strong_components(Graph(edges, graph.n_row, graph.n_row)) if directed else connected_components(Graph(edges, graph.n_row, graph.n_row))
    part = settled(part)
    a, b = part.select(F.col("id").alias("src"), F.col("component").alias("ca")), part.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
    inside = edges.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", "weight")
    near, loops = _linked(Graph(inside, graph.n_row, graph.n_row), most)
    root = dict(map(tuple, part.where("id != component").toLocalIterator()))
    cycles, seen = [[i] for i in sorted(set(loops))], set()
    for start in range(len(near)):
        if start in root or not near[start]:
            continue
        walks = [(start, (start,))]
        while walks:
            at, path = walks.pop()
            for j in near[at]:
                if not directed and len(path) > 1 and j == path[-2]:
                    continue
                if j not in path:
                    walks.append((j, (*path, j)))
                    continue
                cycle = path[path.index(j) :]
                turn = cycle.index(min(cycle))
                cycle = cycle[turn:] + cycle[:turn]
                key = cycle if directed else tuple(sorted(cycle))
                if key not in seen:
                    seen.add(key)
                    cycles.append(list(cycle))
    return cycles


def break_cycles(graph: Graph, root: int | list[int], directed: bool | None = None, most: int = MOST_EDGES) -> Graph:
    """The graph without self-loops and without the edges that lead back into the path of a depth-first walk from the root.

    Linear in the edges; for graphs that one process holds.
    """
    spark = graph.edges.sparkSession
    roots = [root] if isinstance(root, int) else list(root)
    symmetric = is_symmetric(graph)
    if directed is False and not symmetric:
        raise ValueError("the graph is directed")
    directed = not symmetric if directed is None else directed
    near, _ = _linked(graph, most)
    if not roots or any(not near[r] for r in roots):
        raise ValueError("a root has to have a successor")
    state, gone = [0] * len(near), set()  # 0: not met, 1: on the path, 2: left
    for start in [*roots, *range(len(near))]:
        if state[start]:
            continue
        state[start] = 1
        walk = [(start, -1, iter(near[start]))]
        while walk:
            at, before, rest = walk[-1]
            j = next(rest, None)
            if j is None:
                state[at] = 2
                walk.pop()
            elif directed and state[j] == 1:
                gone.add((at, j))
            elif not directed and j != before and state[j] and (j, at) not in gone:
                gone |= {(at, j), (j, at)} if state[j] == 1 else set()
            elif state[j] == 0:
                state[j] = 1
                walk.append((j, at, iter(near[j])))
    kept = graph.edges.where("src != dst")
    if gone:
        pairs = sorted(gone)
        kept = kept.join(as_rows(spark, "src bigint, dst bigint", [a for a, _ in pairs], [b for _, b in pairs]), ["src", "dst"], "left_anti")
    return Graph(kept.select("src", "dst", "weight"), graph.n_row, graph.n_col)


def are_isomorphic(a: Graph, b: Graph, max_iter: int = -1) -> bool:
    """Whether colour refinement can't tell the graphs apart: False is certain, True isn't."""
    if a.n_row != b.n_row or a.edges.count() != b.edges.count():
        return False
    n = a.n_row
    moved = b.edges.select((F.col("src") + n).alias("src"), (F.col("dst") + n).alias("dst"), "weight")
    both = Graph(a.edges.select("src", "dst", "weight").unionByName(moved), 2 * n, 2 * n)
    counts = color_refinement(both, max_iter).groupBy("color").agg(F.count_if(F.col("id") < n).alias("x"), F.count_if(F.col("id") >= n).alias("y"))
    return counts.where("x != y").isEmpty()


def as_table(spark: SparkSession, cycles: list[list[int]]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in cycles], "cycle array<bigint>")
