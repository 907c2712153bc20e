"""Distances, components, cores and triangles over edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, directed2undirected
from .loops import settled
from .spread import MOST_NODES, closed_wedges, column, rows_of, strips, table


def hops_from(graph: Graph, sources: DataFrame) -> DataFrame:
    """(id, distance) of the nodes that sources(id) lead to, in hops from the nearest."""
    edges = settled(graph.edges.where("weight != 0").select("src", "dst").distinct())
    seen = settled(graph.nodes.join(sources.select("id"), "id", "left_semi").select("id", F.lit(0).alias("distance")))
    front, hop = seen, 0
    while True:
        hop += 1
        front = settled(edges.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(hop).alias("distance")))
        if front.isEmpty():
            return seen
        seen = settled(seen.unionByName(front))


def distances(graph: Graph, sources: list[int]) -> DataFrame:
    """(id, distance) in hops from the nearest source, -1 where none leads."""
    seen = hops_from(graph, graph.nodes.where(F.col("id").isin(sources)))
    return graph.nodes.join(seen, "id", "left").select("id", F.coalesce("distance", F.lit(-1)).alias("distance"))


def shortest_path_dag(graph: Graph, sources: list[int]) -> DataFrame:
    """Edges that lead one hop away from the sources."""
    d = distances(graph, sources)
    a, b = d.select(F.col("id").alias("src"), F.col("distance").alias("da")), d.select(F.col("id").alias("dst"), F.col("distance").alias("db"))
    return graph.edges.where("weight != 0").join(a, "src").join(b, "dst").where("da >= 0 and db > da").select("src", "dst", "weight")


def connected_components(graph: Graph) -> DataFrame:
    """(id, component): the smallest id of the weak component, by minimum labels with pointer jumping."""
    both = settled(graph.edges.select("src", "dst").unionByName(graph.transpose().edges.select("src", "dst")).where("src != dst").distinct())
    label = graph.nodes.select("id", F.col("id").alias("component"))
    while True:
        near = both.join(label.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        least = label.join(near, "id", "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = settled(least.join(jump, "component", "left").select("id", F.least("component", "further").alias("component"), "old"))
        label = new.select("id", "component")
        if new.where("component != old").isEmpty():
            return label


def _oriented(graph: Graph) -> DataFrame:
    """Each undirected pair once, from the end of lower (degree, id): no node then has many out-edges."""
    pairs = directed2undirected(graph, weighted=False).edges.where("src != dst").select("src", "dst")
    degree = pairs.groupBy("src").agg(F.count("*").alias("d"))
    told = pairs.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return told.where("d < e or d = e and src < dst").select("src", "dst")


def count_triangles(graph: Graph) -> DataFrame:
    """One row, n: wedges of the oriented edges, closed by a third."""
    return closed_wedges(settled(_oriented(graph)), graph.n, False).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


def count_cliques(graph: Graph, size: int = 3) -> DataFrame:
    """One row, n: sets of size nodes that are all linked.

    A clique's nodes lie along the oriented edges in one order, the others among the successors of the first; the edges among
    those are the closed wedges of the first node, so its cliques are counted where these lie together.
    """
    if size < 2:
        return graph.nodes.agg(F.count("*").alias("n"))
    e = settled(_oriented(graph))
    if size == 2:
        return e.agg(F.count("*").alias("n"))
    if size == 3:
        return count_triangles(graph)
    near = closed_wedges(e, graph.n, True).groupBy("a").agg(F.collect_list(F.struct(F.col("b").cast("int").alias("b"), "near")).alias("rows"))

    def count(batches):
        for batch in batches:
            column = batch.column("rows")
            for i in range(len(column)):
                yield pa.RecordBatch.from_arrays([pa.array([cliques_of({r["b"]: r["near"] for r in column[i].as_py()}, size - 1)])], ["k"])

    return near.select("rows").mapInArrow(count, "k bigint").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


def cliques_of(near: dict[int, list[int]], size: int) -> int:
    """Sets of size >= 3 nodes that are all linked, along edges that lead from a node to those of its list."""
    place = {b: i for i, b in enumerate(sorted(set(near).union(*near.values())))}
    bits = {place[b]: sum(1 << place[c] for c in ends) for b, ends in near.items()}

    def grown(among: int, more: int) -> int:
        if more == 1:
            return among.bit_count()
        told, left = 0, among
        while left:
            low = left & -left
            left ^= low
            if further := among & bits.get(low.bit_length() - 1, 0):
                told += grown(further, more - 1)
        return told

    return grown((1 << len(place)) - 1, size)


def clustering_coefficient(graph: Graph) -> DataFrame:
    """One row: 3 triangles over the wedges."""
    degree = directed2undirected(graph, weighted=False).edges.where("src != dst").groupBy("src").agg(F.count("*").alias("d"))
    wedges = degree.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("wedges"))
    return count_triangles(graph).crossJoin(F.broadcast(wedges)).select((3 * F.col("n") / F.col("wedges")).alias("coefficient"))


def core_decomposition(graph: Graph) -> DataFrame:
    """(id, core): the largest h such that h neighbours have at least h, iterated until stable from the degrees."""
    edges = settled(graph.edges.where("src != dst").select("src", "dst").distinct())
    if graph.n <= MOST_NODES:
        return _cores_in_strips(edges, graph.n)
    core = settled(graph.nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core")), "id", "left").na.fill(0))
    while True:
        near = edges.join(core.select(F.col("id").alias("dst"), F.col("core").alias("c")), "dst").groupBy("src", "c").agg(F.count("*").alias("k"))
        sums = F.sum("k").over(Window.partitionBy("src").orderBy(F.desc("c")))
        h = near.select("src", F.least("c", sums).alias("h")).groupBy(F.col("src").alias("id")).agg(F.max("h").alias("h"))
        new = settled(core.join(h, "id", "left").select("id", F.least("core", F.coalesce("h", F.lit(0))).alias("core"), F.col("core").alias("old")))
        core = new.select("id", "core")
        if new.where("core != old").isEmpty():
            return core


def _cores_in_strips(edges: DataFrame, n: int) -> DataFrame:
    """core_decomposition() where an array over the nodes fits the driver: a round is one job over edges that stay where they are."""
    spark = edges.sparkSession
    matrix = settled(strips(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("weight"))))
    core = column(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core")), n).astype(np.int64)
    while True:
        told = spark.sparkContext.broadcast(core)

        def task(batches):
            for ids, starts, near, _ in rows_of(batches):
                size = np.diff(np.r_[starts, near.size])
                at, c = np.repeat(np.arange(ids.size), size), told.value[near]
                c = c[np.lexsort((-c, at))]
                h = np.minimum(told.value[ids], np.maximum.reduceat(np.minimum(c, np.arange(c.size) - starts[at] + 1), starts))
                less = h < told.value[ids]
                yield pa.RecordBatch.from_arrays([pa.array(ids[less]), pa.array(h[less])], ["id", "h"])

        found = matrix.mapInArrow(task, "id bigint, h bigint").toArrow()
        told.destroy()
        if not found.num_rows:
            return table(spark, core, "core", "bigint")
        core = core.copy()
        core[found.column("id").to_numpy()] = found.column("h").to_numpy()


def strong_components(graph: Graph) -> DataFrame:
    """(id, component): the smallest id of the strong component.

    Each round first sets aside nodes without a predecessor or successor among those left, then gives every node the
    smallest id that leads to it; the nodes of one such colour that lead back to its root are a component.
    """
    edges = settled(graph.edges.where("src != dst and weight != 0").select("src", "dst").distinct())
    left, done = settled(graph.nodes.select("id")), []
    while not left.isEmpty():
        inner = edges.select(F.col("src").alias("id")).intersect(edges.select(F.col("dst").alias("id")))
        alone = left.join(inner, "id", "left_anti")
        if not alone.isEmpty():
            done.append(settled(alone.select("id", F.col("id").alias("component"))))
            left = settled(left.join(inner, "id", "left_semi"))
        else:
            color = _least_label(left.select("id", F.col("id").alias("component")), edges)
            a = color.select(F.col("id").alias("src"), F.col("component").alias("ca"))
            b = color.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
            back = settled(edges.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
            front = settled(color.where("id = component"))
            found = front
            while not front.isEmpty():
                front = front.select(F.col("id").alias("dst"), "component").join(back, "dst").select(F.col("src").alias("id"), "component").distinct()
                front = settled(front.join(found, "id", "left_anti"))
                found = settled(found.unionByName(front))
            done.append(found)
            left = settled(left.join(found, "id", "left_anti"))
        edges = edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi")
        edges = settled(edges.select("src", "dst"))
    if not done:
        return graph.nodes.select("id", F.col("id").alias("component"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def _least_label(label: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (id, component), lowered along the edges until they are stable."""
    while True:
        near = edges.join(label.select(F.col("id").alias("src"), "component"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("near"))
        new = settled(label.join(near, "id", "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old")))
        label = new.select("id", "component")
        if new.where("component != old").isEmpty():
            return label


def is_connected(graph: Graph, strong: bool = False) -> bool:
    part = strong_components(graph) if strong else connected_components(graph)
    return part.select("component").distinct().limit(2).count() == 1


def is_acyclic(graph: Graph) -> bool:
    """Whether a directed graph has no cycle, self-loops included: peeling nodes without predecessors leaves no edge."""
    edges = settled(graph.edges.where("weight != 0").select("src", "dst").distinct())
    n = edges.count()
    while n:
        edges = settled(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        n, before = edges.count(), n
        if n == before:
            return False
    return True


def is_bipartite(graph: Graph) -> bool:
    """Whether an undirected graph has no odd cycle: in its double cover no node meets its own copy."""
    e = graph.edges.where("weight != 0").select("src", "dst")
    cover = e.select((2 * F.col("src")).alias("src"), (2 * F.col("dst") + 1).alias("dst")).unionByName(e.select((2 * F.col("src") + 1).alias("src"), (2 * F.col("dst")).alias("dst")))
    part = connected_components(Graph(cover.withColumn("weight", F.lit(1.0)), 2 * graph.n_row, 2 * graph.n_row))
    odd = part.groupBy(F.floor(F.col("id") / 2).alias("node")).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low = high")
    return odd.isEmpty()


def largest_component(graph: Graph, strong: bool = False) -> DataFrame:
    """(id) of the component with the most nodes, ties to the smaller component id."""
    part = settled(strong_components(graph) if strong else connected_components(graph))
    best = part.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return part.join(F.broadcast(best), "component").select("id")  # one row


def color_refinement(graph: Graph, max_iter: int = -1) -> DataFrame:
    """(id, color): Weisfeiler-Lehman classes of a graph's rows, named by their smallest node.

    A round groups nodes by their colour and the sorted colours of their neighbours, told by two hashes of the counts of
    each colour (so a hub's neighbours are counted before they meet), until no class splits.
    """
    edges = settled(graph.edges.where("weight != 0").select("src", "dst").distinct())
    color, n, done = graph.nodes.select("id", F.lit(0).cast("bigint").alias("color")), min(1, graph.n), 0
    while max_iter < 0 or done < max_iter:
        near = edges.join(color.select(F.col("id").alias("dst"), F.col("color").alias("c")), "dst").groupBy("src", "c").agg(F.count("*").alias("k"))
        mixed = near.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.xxhash64(F.lit(i), "c", "k").cast("decimal(20,0)")).alias(f"h{i}") for i in (1, 2)])
        told = settled(color.join(mixed, "id", "left"))
        key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("color", "h1", "h2")]
        told = told.select("id", *key)
        names = told.groupBy("color", "h1", "h2").agg(F.min("id").alias("least"))
        color = settled(told.join(names, ["color", "h1", "h2"]).select("id", F.col("least").alias("color")))
        done, before, n = done + 1, n, color.select("color").distinct().count()
        if n == before:
            break
    return color
