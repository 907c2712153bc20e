"""Metrics, seed-based regression and classification, tf-idf and cosine links.

Several classes, centres or sources are one plan with a longer key, never a loop over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, get_adjacency
from .loops import settled
from .ranking import normalized_rows, spmv


def modularity(graph: Graph, labels: DataFrame, labels_col: DataFrame | None = None, resolution: float = 1.0, weights: str = "degree") -> DataFrame:
    """One row: fit, diversity and their difference, for labels(id, label) of nodes, or of rows and of columns.

    The diversity is over what edges leave and enter clusters ('degree') or over their numbers of nodes ('uniform').
    """
    if graph.bipartite and labels_col is None:
        raise ValueError("the labels of columns are needed too")
    other = labels if labels_col is None else labels_col
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), other.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    pairs = graph.edges.join(a, "src").join(b, "dst").groupBy("la", "lb").agg(F.sum("weight").alias("w"))
    total = pairs.agg(F.sum("w").alias("total"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inside"))
    out, into = pairs.groupBy("la").agg(F.sum("w").alias("out")), pairs.groupBy("lb").agg(F.sum("w").alias("into"))
    if weights == "uniform":  # in units of the edges' sum, as the other
        share = lambda t, n, name, side: t.groupBy(F.col("label").alias(side)).agg((F.count("*") / n).alias(name))
        unit = graph.edges.agg(F.sum("weight").alias("unit"))
        out = share(labels, graph.n_row, "out", "la").crossJoin(F.broadcast(unit)).select("la", (F.col("out") * F.col("unit")).alias("out"))  # one row
        into = share(other, graph.n_col, "into", "lb").crossJoin(F.broadcast(unit)).select("lb", (F.col("into") * F.col("unit")).alias("into"))
    elif weights != "degree":
        raise ValueError(f"weights are 'degree' or 'uniform', not {weights!r}")
    spread = out.join(into, out.la == into.lb).agg(F.sum(F.col("out") * F.col("into")).alias("spread"))
    told = total.crossJoin(spread).select((F.col("inside") / F.col("total")).alias("fit"), (F.coalesce("spread", F.lit(0.0)) / F.col("total") ** 2).alias("diversity"))
    return told.select("fit", "diversity", (F.col("fit") - resolution * F.col("diversity")).alias("modularity"))


def aggregate_graph(graph: Graph, labels: DataFrame | None = None, labels_row: DataFrame | None = None, labels_col: DataFrame | None = None) -> DataFrame:
    """Edges between labels of nodes, or of rows and of columns; negative labels drop out."""
    row, col = (labels_row if labels_row is not None else labels), (labels_col if labels_col is not None else labels)
    if row is None or col is None:
        raise ValueError("labels, or those of rows and of columns, are needed")
    row, col = row.where("label >= 0"), col.where("label >= 0")
    a, b = row.select(F.col("id").alias("src"), F.col("label").alias("src_label")), col.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return graph.edges.join(a, "src").join(b, "dst").groupBy("src_label", "dst_label").agg(F.sum("weight").alias("weight"))


def reindex_labels(labels: DataFrame) -> DataFrame:
    """(id, label) renumbered by decreasing size, ties to the smaller old label; labels may be as many as nodes."""
    from ..sources.tables import numbered

    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    place = numbered(sizes.select(F.struct((-F.col("n")).alias("n"), "label").alias("name")))
    return labels.join(place.select(F.col("name.label").alias("label"), F.col("id").alias("new")), "label").select("id", F.col("new").alias("label"))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """pairs(label_true, label_pred) -> counts, rows with a negative label left out."""
    return pairs.where("label_true >= 0 and label_pred >= 0").groupBy("label_true", "label_pred").agg(F.count("*").alias("n"))


def f1_scores(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1; 0 where undefined."""
    known = pairs.where("label_true >= 0 and label_pred >= 0")
    true = known.groupBy(F.col("label_true").alias("label")).agg(F.count("*").alias("t"), F.count_if(F.col("label_true") == F.col("label_pred")).alias("hit"))
    pred = known.groupBy(F.col("label_pred").alias("label")).agg(F.count("*").alias("p"))
    both = true.join(pred, "label", "full").na.fill(0)
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    both = both.select("label", share(F.col("hit"), F.col("p")).alias("precision"), share(F.col("hit"), F.col("t")).alias("recall"))
    return both.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def dirichlet(graph: Graph, seeds: DataFrame, n_iter: int = 10, init: float | None = None) -> DataFrame:
    """(id, value): every node takes the weighted mean of its successors, seeds(id, value) stay.  Others begin at init, or the seeds' mean."""
    return _spread(graph, seeds, n_iter, clamp=True, init=init)


def diffusion(graph: Graph, seeds: DataFrame, n_iter: int = 3, damping_factor: float = 0.5, init: float | None = None) -> DataFrame:
    """(id, value): v becomes (1 - a) v + a mean over predecessors; nodes without one keep theirs."""
    return _spread(graph, seeds, n_iter, damping_factor=damping_factor, init=init)


def _spread(graph: Graph, seeds: DataFrame, n_iter: int, clamp: bool = False, damping_factor: float = 1.0, init: float | None = None) -> DataFrame:
    square = get_adjacency(graph)
    known = settled(seeds.where("value >= 0").select("id", F.col("value").alias("seed")))
    mean = known.agg(F.avg("seed")).first()[0] if init is None else float(init)
    nodes = settled(square.nodes.join(known, "id", "left"))
    p = settled(normalized_rows(square if clamp else square.transpose()))
    x = nodes.select("id", F.coalesce("seed", F.lit(mean)).alias("value"))
    for _ in range(n_iter):
        moved = spmv(p, x).withColumnRenamed("value", "moved")
        joined = x.join(moved, "id", "left").join(nodes, "id")
        if clamp:
            new = F.coalesce("seed", "moved", F.lit(0.0))
        else:
            new = F.when(F.col("moved").isNull(), F.col("value")).otherwise((1 - damping_factor) * F.col("value") + damping_factor * F.col("moved"))
        x = settled(joined.select("id", new.alias("value")), old=x)
    return x


def tfidf(counts: DataFrame, n_rows: int) -> DataFrame:
    """counts(src, dst, weight) -> L1 row share times ln(rows / rows that hold the column)."""
    total = counts.groupBy("src").agg(F.sum("weight").alias("total"))
    holds = counts.where("weight > 0").groupBy("dst").agg(F.count("*").alias("df"))
    return counts.join(total, "src").join(holds, "dst").select("src", "dst", (F.col("weight") / F.col("total") * F.log(n_rows / F.col("df"))).alias("weight"))


def nearest_links(graph: Graph, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """(src, dst, similarity): the k rows with the largest cosine to each row, itself included."""
    norms = graph.edges.groupBy("src").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    unit = settled(graph.edges.join(norms, "src").select("src", "dst", (F.col("weight") / F.col("norm")).alias("w")))
    other = unit.select(F.col("src").alias("cand"), "dst", F.col("w").alias("v"))
    sims = unit.join(other, "dst").groupBy("src", "cand").agg(F.sum(F.col("w") * F.col("v")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = sims.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("similarity", 9)), "cand")))
    return best.where(F.col("place") <= k).select("src", F.col("cand").alias("dst"), "similarity")


def laplacian(graph: Graph) -> DataFrame:
    """D - A as edges."""
    degree = graph.edges.groupBy("src").agg(F.sum("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    return degree.unionByName(graph.edges.withColumn("weight", -F.col("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
