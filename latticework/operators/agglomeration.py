"""Building hierarchies: dendrogram(step, left, right, height, size), step t making cluster n + t.

Paris merges, as long as there are edges, pairs of clusters that are each other's most similar ones; the similarity of i and j is
2 w_ij / (p_i q_j + p_j q_i) and a merge's height its inverse.  Merging a pair never makes a third cluster more similar, so the order
of such merges doesn't matter: small graphs are merged along chains in one process, larger ones by rounds in Spark, all mutual
pairs at once.  The other two nest Louvain's clusters, from the top down or from the bottom up.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, get_adjacency
from ..sources.tables import numbered
from .checks import check_min_size, check_nonnegative
from .communities import _gains, local_levels
from .hierarchy import cut_straight
from .local import MOST_EDGES, LocalGraph, as_rows, collected, fits
from .loops import settled

SCHEMA = "step bigint, left bigint, right bigint, height double, size bigint"


def _table(spark: SparkSession, merges: list[tuple[int, int, float, int]]) -> DataFrame:
    columns = list(zip(*merges)) if merges else [()] * 4
    return as_rows(spark, SCHEMA, list(range(len(merges))), *map(list, columns))


def reordered(merges: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
    """The merges by height, those of one height by their later part, with clusters numbered anew."""
    n = len(merges) + 1
    order = sorted(range(n - 1), key=lambda t: (merges[t][2], max(merges[t][:2])))
    new = {n + t: n + place for place, t in enumerate(order)}
    return [(new.get(a, a), new.get(b, b), h, s) for a, b, h, s in (merges[t] for t in order)]


def reorder_dendrogram(dendrogram: DataFrame, n: int) -> DataFrame:
    """reordered() for a table of any size."""
    key = F.struct("height", F.greatest("left", "right").alias("last"), "step")
    place = numbered(dendrogram.select(key.alias("name"))).select(F.col("name.step").alias("old"), F.col("id").alias("new"))
    place = settled(place)
    name = lambda side: F.coalesce(F.col(f"new_{side}") + n, F.col(side)).alias(side)
    told = dendrogram.join(place.select(F.col("old").alias("step"), F.col("new").alias("place")), "step")
    for side in ("left", "right"):
        told = told.join(place.select((F.col("old") + n).alias(side), F.col("new").alias(f"new_{side}")), side, "left")
    return told.select(F.col("place").alias("step"), name("left"), name("right"), "height", "size")


def _chains(graph: LocalGraph, p: list[float], q: list[float]) -> list[tuple[int, int, float, int]]:
    """Merges of a graph whose weights are summed over both directions; parts without an edge between them are joined last."""
    n = graph.n
    near: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    for i, j, w in zip(graph.src.tolist(), graph.dst.tolist(), graph.weight.tolist()):
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
    size, merges, done = dict.fromkeys(range(n), 1), [], []
    p, q = dict(enumerate(p)), dict(enumerate(q))
    waiting = list(range(n))

    def alike(i: int, j: int) -> float:
        both = p[i] * q[j] + p[j] * q[i]
        return 2 * near[i][j] / both if both > 0 else float("inf")

    while waiting:
        chain = [heapq.heappop(waiting)]
        if chain[0] not in near:
            continue
        while chain:
            i = chain[-1]
            if not near[i]:
                done.append(i)
                chain.pop()
                continue
            best = max(alike(i, j) for j in near[i])
            ties = [j for j in near[i] if alike(i, j) == best]
            j = chain[-2] if len(chain) > 1 and chain[-2] in ties else min(ties)
            if len(chain) < 2 or j != chain[-2]:
                chain.append(j)
                continue
            del chain[-2:]
            k = n + len(merges)
            merges.append((min(i, j), max(i, j), float(f"{1 / best:.12g}") if best else float("inf"), size[i] + size[j]))
            size[k], p[k], q[k] = size.pop(i) + size.pop(j), p.pop(i) + p.pop(j), q.pop(i) + q.pop(j)
            mine = near.pop(i)
            for x, w in near.pop(j).items():
                mine[x] = mine.get(x, 0.0) + w
            near[k] = {x: w for x, w in mine.items() if x not in (i, j)}
            for x, w in near[k].items():
                near[x].pop(i, None)
                near[x].pop(j, None)
                near[x][k] = w
            heapq.heappush(waiting, k)
    if done:
        top = done.pop()
        while done:
            other = done.pop()
            merges.append((top, other, float("inf"), size[top] + size[other]))
            top, size[n + len(merges) - 1] = n + len(merges) - 1, size[top] + size[other]
    return merges


def paris(graph: Graph, weights: str = "degree", reorder: bool = True, force_bipartite: bool = False, most: int = MOST_EDGES) -> DataFrame:
    """The dendrogram of a graph's nodes, of rows and then columns for a bipartite one; parts that no edge joins merge at infinity."""
    if weights not in ("degree", "uniform"):
        raise ValueError(f"weights are 'degree' or 'uniform', not {weights!r}")
    square = get_adjacency(graph, force_bipartite=force_bipartite)
    check_min_size(square.n, 2)
    check_nonnegative(square.edges)
    spark = square.edges.sparkSession
    if not fits(square, most):
        return _mutual_rounds(square, weights)
    local = collected(square, most)
    both, out, into = _gains(local, "potts" if weights == "uniform" else "dugue")
    merges = _chains(both, out.tolist(), into.tolist())
    return _table(spark, reordered(merges) if reorder else merges)


def _mutual_rounds(square: Graph, weights: str) -> DataFrame:
    spark, n = square.edges.sparkSession, square.n
    total = square.edges.agg(F.sum("weight")).first()[0] or 1.0
    turned = square.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    edges = square.edges.select("src", "dst", "weight").unionByName(turned).where("src != dst").groupBy("src", "dst").agg((F.sum("weight") / (2 * total)).alias("w"))
    edges = settled(edges)
    if weights == "uniform":
        nodes = square.nodes.select("id", F.lit(1 / n).alias("p"), F.lit(1 / n).alias("q"), F.lit(1).cast("bigint").alias("size"))
    else:
        side = lambda c, name: square.edges.groupBy(F.col(c).alias("id")).agg((F.sum("weight") / total).alias(name))
        nodes = square.nodes.join(side("src", "p"), "id", "left").join(side("dst", "q"), "id", "left").na.fill(0.0).withColumn("size", F.lit(1).cast("bigint"))
    nodes, found, made = settled(nodes), [], 0
    while not edges.isEmpty():
        a, b = nodes.select(F.col("id").alias("src"), F.col("p").alias("pa"), F.col("q").alias("qa")), nodes.select(F.col("id").alias("dst"), F.col("p").alias("pb"), F.col("q").alias("qb"))
        alike = edges.join(a, "src").join(b, "dst").select("src", "dst", (2 * F.col("w") / (F.col("pa") * F.col("qb") + F.col("pb") * F.col("qa"))).alias("alike"))
        best = settled(alike.groupBy("src").agg(F.max_by(F.struct("dst", "alike"), F.struct("alike", -F.least("src", "dst"), -F.greatest("src", "dst"))).alias("b")).select("src", "b.dst", "b.alike"))
        back = best.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        pairs = best.join(back, ["src", "dst"]).where("src < dst")
        order = numbered(pairs.select(F.col("src").alias("name")))
        pairs = settled(pairs.join(order.select(F.col("name").alias("src"), (F.col("id") + n + made).alias("new")), "src"))
        made += pairs.count()
        moved = settled(pairs.select(F.explode(F.array("src", "dst")).alias("id"), "new"))
        to = nodes.join(moved, "id", "left").select("id", F.coalesce("new", "id").alias("new"), "p", "q", "size")
        merged = settled(to.groupBy(F.col("new").alias("id")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("size").alias("size")))
        found.append(settled(pairs.join(merged.select(F.col("id").alias("new"), "size"), "new").select((F.col("new") - n).alias("step"), F.col("src").alias("left"), F.col("dst").alias("right"), F.round(1 / F.col("alike"), 12).alias("height"), "size")))
        name = to.select("id", "new")
        x, y = name.select(F.col("id").alias("src"), F.col("new").alias("a")), name.select(F.col("id").alias("dst"), F.col("new").alias("b"))
        edges = settled(edges.join(x, "src").join(y, "dst").where("a != b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), old=edges)
        nodes = merged
    rest = nodes.orderBy("id").limit(MOST_EDGES + 1).collect()  # parts of the graph that no edge joins
    if len(rest) > MOST_EDGES:
        raise ValueError(f"the graph falls into more than {MOST_EDGES} parts")
    joins, top = [], rest[0] if rest else None
    for at, other in enumerate(rest[1:]):
        size = (joins[-1][4] if joins else top["size"]) + other["size"]
        joins.append((made + at, joins[-1][0] + n if joins else top["id"], other["id"], float("inf"), size))
    whole = as_rows(spark, SCHEMA, *([list(c) for c in zip(*joins)] if joins else [[]] * 5))
    for part in found:
        whole = whole.unionByName(part)
    return reorder_dendrogram(settled(whole), n)


Tree = int | list


def tree_merges(tree: Tree, n: int) -> list[tuple[int, int, float, int]]:
    """The merges of nested lists of nodes: the members of a list, deepest lists first, one after the other, at minus its depth."""
    merges: list[tuple[int, int, float, int]] = []
    size: dict[int, int] = {}

    def merged(part: Tree, depth: int) -> int:
        if not isinstance(part, list):
            return part
        ids = [merged(x, depth + 1) for x in part]
        top = ids[0]
        for other in ids[1:]:
            merges.append((top, other, float(-depth), size.get(top, 1) + size.get(other, 1)))
            top = n + len(merges) - 1
            size[top] = merges[-1][3]
        return top

    merged(tree, 0)
    low = min((m[2] for m in merges), default=0.0)
    return [(a, b, h + 1 - low, s) for a, b, h, s in merges]


def get_index(tree: Tree) -> int:
    """The largest node in a tree."""
    return max(map(get_index, tree)) if isinstance(tree, list) else tree


def get_dendrogram(spark: SparkSession, tree: Tree) -> DataFrame:
    return _table(spark, reordered(tree_merges(tree, get_index(tree) + 1)))


def _labels(local: LocalGraph, how: dict) -> np.ndarray:
    both, out, into = _gains(local, "dugue")
    return local_levels(both, out, into, how["resolution"], how["tol_optimization"], how["tol_aggregation"], how["n_aggregations"], False)[-1]


def louvain_iteration(graph: Graph, depth: int = 3, resolution: float = 1, tol_optimization: float = 1e-3, tol_aggregation: float = 1e-3, n_aggregations: int = -1, force_bipartite: bool = False, most: int = MOST_EDGES) -> DataFrame:
    """Louvain inside the clusters of Louvain, down to a depth.  For graphs that one process holds."""
    square = get_adjacency(graph, force_bipartite=force_bipartite)
    how = {"resolution": resolution, "tol_optimization": tol_optimization, "tol_aggregation": tol_aggregation, "n_aggregations": n_aggregations}

    def nested(local: LocalGraph, nodes: np.ndarray, left: int) -> Tree:
        labels = _labels(local, how) if left and local.weight.size else np.zeros(local.n, int)
        if labels.max(initial=0) == 0:
            return nodes.tolist() if nodes.size > 1 else int(nodes[0])
        parts = []
        for c in range(labels.max() + 1):
            mine = labels == c
            place = np.cumsum(mine) - 1
            inside = mine[local.src] & mine[local.dst]
            part = LocalGraph(place[local.src[inside]], place[local.dst[inside]], local.weight[inside], int(mine.sum()))
            parts.append(nested(part, nodes[mine], left - 1))
        return parts

    local = collected(square, most)
    return _table(square.edges.sparkSession, reordered(tree_merges(nested(local, np.arange(local.n), depth), local.n)))


def louvain_hierarchy(graph: Graph, resolution: float = 1, tol_optimization: float = 1e-3, tol_aggregation: float = 1e-3, force_bipartite: bool = False, most: int = MOST_EDGES) -> DataFrame:
    """The clusters of one aggregation of Louvain, the clusters of these, and so on.  For graphs that one process holds."""
    square = get_adjacency(graph, force_bipartite=force_bipartite)
    local = collected(square, most)
    both, out, into = _gains(local, "dugue")
    tree: list[Tree] = list(range(local.n))
    for labels in _single_levels(both, out, into, resolution, tol_optimization):
        groups: dict[int, list[Tree]] = {}
        for part, c in zip(tree, labels.tolist()):
            groups.setdefault(c, []).append(part)
        tree = [g[0] if len(g) == 1 else g for _, g in sorted(groups.items())]
    return _table(square.edges.sparkSession, reordered(tree_merges(tree if len(tree) > 1 else tree[0], local.n)))


def _single_levels(graph: LocalGraph, out: np.ndarray, into: np.ndarray, resolution: float, tol: float):
    """Labels of each level's clusters, until one merges nothing."""
    from .communities import _merged

    while graph.n:
        labels = local_levels(graph, out, into, resolution, tol, 0.0, 1, False)[-1]
        n = int(labels.max()) + 1
        yield labels
        if n in (graph.n, 1):
            return
        graph, out, into = _merged(graph, out, into, labels, n)


def split_dendrogram(dendrogram: DataFrame, n_row: int, n_col: int) -> tuple[DataFrame, DataFrame]:
    """A bipartite dendrogram's merges of rows alone, and of columns alone; a merge of rows with columns passes the parts on.  Held by
    the driver: one row for each node."""
    merges = [tuple(r) for r in dendrogram.orderBy("step").select("left", "right", "height").toLocalIterator()]
    n, found = n_row + n_col, []
    for begin, many in ((0, n_row), (n_row, n_col)):
        name = {begin + i: i for i in range(many)}
        size, rows = dict.fromkeys(range(many), 1), []
        for t, (a, b, h) in enumerate(merges):
            known = [name.pop(x) for x in (int(a), int(b)) if x in name]
            if len(known) == 2:
                new = many + len(rows)
                size[new] = size[known[0]] + size[known[1]]
                rows.append((*known, h, size[new]))
                known = [new]
            if known:
                name[n + t] = known[0]
        found.append(_table(dendrogram.sparkSession, rows))
    return found[0], found[1]


def cut_with_dendrogram(dendrogram: DataFrame, n: int, labels: DataFrame) -> DataFrame:
    """The dendrogram of a cut's clusters, numbered by their labels: the merges above the cut."""
    name = dict(map(tuple, labels.select("id", "label").toLocalIterator()))
    size, rows, of, k = {}, [], dict(name), len(set(name.values()))
    for c in name.values():
        size[c] = size.get(c, 0) + 1
    for r in dendrogram.orderBy("step").toLocalIterator():
        a, b = of.pop(int(r["left"])), of.pop(int(r["right"]))
        if a != b:
            rows.append((a, b, r["height"], r["size"]))
            a = k + len(rows) - 1
        of[n + r["step"]] = a
    return _table(dendrogram.sparkSession, rows)


__all__ = ["cut_straight", "cut_with_dendrogram", "get_dendrogram", "get_index", "louvain_hierarchy", "louvain_iteration", "paris", "reorder_dendrogram", "split_dendrogram", "tree_merges"]
