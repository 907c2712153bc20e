"""PageRank, Katz, HITS and top-k.  Every round is one join of edges with the vector and one sum by node, or, for PageRank and Katz
of up to spread.MOST_NODES nodes, a product with strips of the matrix that stay where they are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, get_adjacency
from . import spread
from .loops import remove, settled, watched


def spmv(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(id, value): sum over a row's edges of weight times x at dst; rows without an edge are absent."""
    told = x.select(F.col("id").alias("dst"), "value")
    return edges.join(told, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def normalized_rows(graph: Graph) -> DataFrame:
    """Edges divided by their row's sum; rows that sum to 0 vanish."""
    total = graph.edges.groupBy("src").agg(F.sum("weight").alias("total")).where("total != 0")
    return graph.edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("weight"))


SOLVERS = ("piteration", "diteration", "push", "RH", "bicgstab", "lanczos")


def pagerank(graph: Graph, damping_factor: float = 0.85, n_iter: int = 10, seeds: DataFrame | None = None, tol: float = 1e-6, solver: str = "piteration") -> DataFrame:
    """(id, score).  seeds(id, value) default to all nodes, or the rows of a bipartite graph; negative values count as 0.

    piteration: x becomes a P'x + b sum(x) with b = (1 - a [out-degree > 0]) s, n_iter times at most; it stops at the round
    before the one whose normalised change is below tol.  The map is linear, so one normalisation at the end equals one a
    round.  lanczos: the same up to its fixed point.  The others add up walks: RH up to n_iter steps from s; diteration and push
    until what still moves is below tol (diteration at most n_iter steps); bicgstab from b, the solution of (I - a P')x = b.
    """
    if solver not in SOLVERS:
        raise ValueError(f"no such solver: {solver}")
    square = get_adjacency(graph)
    if solver in ("piteration", "lanczos") and square.n <= spread.MOST_NODES:
        return _in_strips(square, graph.n_row, damping_factor, n_iter if solver == "piteration" else 10_000, seeds, tol)
    if seeds is None:
        seeds = square.nodes.select("id", (F.col("id") < graph.n_row).cast("double").alias("value"))
    seeds = seeds.select("id", F.greatest("value", F.lit(0.0)).alias("value"))
    total = seeds.agg(F.sum("value")).first()[0] or 1.0
    edges = settled(square.edges)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out"))
    start = square.nodes.join(seeds, "id", "left").join(out, "id", "left").select("id", (F.coalesce("value", F.lit(0.0)) / total).alias("s"), F.coalesce("out", F.lit(0.0)).alias("out"))
    leads = (F.col("out") > 0).cast("int")
    start = settled(start.select("id", "s", (F.col("s") * (1 - damping_factor * leads)).alias("b"), leads.alias("leads")))
    told = edges.join(out.where("out != 0"), F.col("src") == F.col("id")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (damping_factor * F.col("weight") / F.col("out")).alias("weight"))
    turned = settled(told, old=edges)
    if solver in ("piteration", "lanczos"):
        x = _iterated(turned, start, damping_factor, n_iter if solver == "piteration" else 10_000, tol)
    else:
        first = {"RH": F.col("s"), "bicgstab": F.col("b")}.get(solver, (1 - damping_factor) * F.col("s"))
        x = _walks(turned, start.select("id", first.alias("value")), n_iter if solver in ("RH", "diteration") else None, 0.0 if solver == "RH" else tol)
    total = x.agg(F.sum("value")).first()[0] or 1.0
    return x.select("id", (F.col("value") / total).alias("score"))


def _in_strips(square: Graph, n_row: int, damping_factor: float, n_iter: int, seeds: DataFrame | None, tol: float) -> DataFrame:
    """_iterated() where a vector fits the driver: the edges are dealt out once, a round moves nothing but the vector."""
    spark = square.edges.sparkSession
    s = (np.arange(square.n) < n_row).astype(float) if seeds is None else np.maximum(spread.column(seeds.select("id", F.col("value").cast("double")), square.n), 0)
    s /= s.sum() or 1.0
    edges = settled(square.edges)
    out = spread.column(edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("value")), square.n)
    matrix = settled(spread.strips(edges), old=edges)
    leads = out > 0
    scale = np.divide(damping_factor, out, out=np.zeros_like(out), where=out != 0)
    b = s * (1 - damping_factor * leads)
    x = b
    for _ in range(n_iter):
        mass = x.sum() or 1.0
        y = spread.product(matrix, x * scale) + b * mass
        if tol and np.abs(y / (y.sum() or 1.0) - x / mass).sum() < tol:
            break
        x = y
    return spread.table(spark, x / (x.sum() or 1.0), "score")


def _iterated(turned: DataFrame, start: DataFrame, damping_factor: float, n_iter: int, tol: float) -> DataFrame:
    """Each round is one job: a join of the edges with the vector, a sum by node, and sums over the vector while it is written.

    What a round's vector adds up to follows from the round before: a times what lies on nodes with successors, plus b's share.
    """
    x = start.select("id", F.col("b").alias("value"), "leads")
    mass, moving = start.agg(F.sum("b"), F.sum(F.col("b") * F.col("leads"))).first()
    share, mass, moving = mass or 0.0, mass or 1.0, moving or 0.0
    for _ in range(n_iter):
        after = damping_factor * moving + share * mass or 1.0
        moved = spmv(turned, x.select("id", "value")).withColumnRenamed("value", "moved")
        told = start.join(moved, "id", "left").join(x.select("id", F.col("value").alias("before")), "id")
        told = told.select("id", (F.coalesce("moved", F.lit(0.0)) + F.col("b") * mass).alias("value"), "leads", "before")
        y, seen = watched(told, moving=F.col("value") * F.col("leads"), change=F.abs(F.col("value") / after - F.col("before") / mass))
        if tol and seen["change"] < tol:
            break
        if path := getattr(x, "_state_path", None):
            remove(x.sparkSession, path)
        x, mass, moving = y, after, seen["moving"]
    return x.select("id", "value")


def _walks(turned: DataFrame, first: DataFrame, n_iter: int | None, tol: float) -> DataFrame:
    """The sum over k of (a P')^k first, up to n_iter or until the last term's sum is below tol."""
    both, done = first.select("id", "value", F.col("value").alias("sum")), 0
    while n_iter is None or done < n_iter:
        moved = spmv(turned, both.select("id", "value")).withColumnRenamed("value", "moved")
        new = F.coalesce("moved", F.lit(0.0))
        both, seen = watched(both.join(moved, "id", "left").select("id", new.alias("value"), (F.col("sum") + new).alias("sum")), old=both, left="value")
        done += 1
        if tol and seen["left"] < tol:
            break
    return both.select("id", F.col("sum").alias("value"))


def katz(graph: Graph, damping_factor: float = 0.5, path_length: int = 4) -> DataFrame:
    """(id, score): sum over k of a^k times the paths of k edges that end at the node."""
    square = get_adjacency(graph)
    turned = square.edges.where("weight != 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    if square.n <= spread.MOST_NODES:
        edges = settled(turned.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        matrix = settled(spread.strips(edges), old=edges)
        x, score = np.ones(square.n), np.zeros(square.n)
        for _ in range(path_length):
            x = damping_factor * spread.product(matrix, x)
            score += x
        return spread.table(graph.edges.sparkSession, score, "score")
    turned = settled(turned)
    both = square.nodes.select("id", F.lit(1.0).alias("value"), F.lit(0.0).alias("score"))
    for _ in range(path_length):
        moved = spmv(turned, both.select("id", "value")).withColumnRenamed("value", "moved")
        new = damping_factor * F.coalesce("moved", F.lit(0.0))
        both = settled(both.join(moved, "id", "left").select("id", new.alias("value"), (F.col("score") + new).alias("score")), old=both)
    return both.select("id", "score")


def hits(graph: Graph, n_iter: int = 100, tol: float = 1e-12) -> DataFrame:
    """(part, id, score): hubs (rows) and authorities (columns), the leading singular pair by power iteration."""
    edges = settled(graph.edges)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    a, h, told = graph.edges.sparkSession.range(graph.n_col).select("id", F.lit(1.0).alias("value")), None, 0.0

    def unit(x: DataFrame, old: DataFrame | None) -> tuple[DataFrame, float]:
        x, seen = watched(x, old, square=F.col("value") ** 2)
        norm = seen["square"] ** 0.5 or 1.0
        y = x.select("id", (F.col("value") / norm).alias("value"))
        y._state_path = x._state_path
        return y, norm

    for _ in range(n_iter):
        h, _ = unit(spmv(edges, a), h)
        a, norm = unit(spmv(turned, h), a)
        if abs(norm - told) <= tol * norm:  # the singular value is stable
            break
        told = norm
    parts = []
    for name, x, n in (("row", h, graph.n_row), ("col", a, graph.n_col)):
        nodes = graph.edges.sparkSession.range(n)
        parts.append(nodes.join(x, "id", "left").select(F.lit(name).alias("part"), "id", F.coalesce("value", F.lit(0.0)).alias("score")))
    return parts[0].unionByName(parts[1])


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k)
