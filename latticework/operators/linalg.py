"""Lazy matrices over edge tables, and solvers that need nothing of a matrix but its products.

A block of vectors is a table (id, v0, v1, ...).  A product is one join of the edges with the block and one sum by row for all its
columns.  Matrices of at most DENSE cells are decomposed by NumPy in one process, larger ones by subspace iteration: the block
stays in Spark, only the products of its columns (a small square matrix) come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from .local import as_rows, vector
from .loops import settled

#: Cells of a matrix that one process decomposes: 32 MB.
DENSE = 4_000_000


def columns_of(block: DataFrame) -> list[str]:
    return [c for c in block.columns if c != "id"]


def dot_columns(edges: DataFrame, block: DataFrame) -> DataFrame:
    """(id, v0, ...): each row's weighted sum of the block; rows without an edge are absent."""
    told = edges.join(block.withColumnRenamed("id", "dst"), "dst")
    return told.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns_of(block)])


def mixed(block: DataFrame, matrix: np.ndarray) -> DataFrame:
    """The block times a small matrix."""
    names = columns_of(block)
    return block.select("id", *[sum((float(matrix[i, j]) * F.col(n) for i, n in enumerate(names)), F.lit(0.0)).alias(f"v{j}") for j in range(matrix.shape[1])])


def gram(x: DataFrame, y: DataFrame | None = None) -> np.ndarray:
    """The products of the columns of x with those of y, or with each other: one row."""
    a = columns_of(x)
    if y is None:
        both, b = x, a
        told = both.agg(*[F.sum(F.col(p) * F.col(q)) for i, p in enumerate(a) for q in b[i:]]).first()
        out, at = np.zeros((len(a), len(a))), iter(told)
        for i in range(len(a)):
            for j in range(i, len(a)):
                out[i, j] = out[j, i] = next(at) or 0.0
        return out
    b = [f"y_{c}" for c in columns_of(y)]
    both = x.join(y.select("id", *[F.col(c).alias(f"y_{c}") for c in columns_of(y)]), "id")
    told = both.agg(*[F.sum(F.col(p) * F.col(q)) for p in a for q in b]).first()
    return np.array([v or 0.0 for v in told]).reshape(len(a), len(b))


@dataclass
class SparseLR:
    """Edges plus products of pairs of vectors: S + sum of x y'.  Each vector is a table (id, value), absent ids being 0."""

    edges: DataFrame
    n_row: int
    n_col: int
    low_rank: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_row, self.n_col

    @property
    def T(self) -> SparseLR:  # noqa: N802
        turned = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return SparseLR(turned, self.n_col, self.n_row, [(y, x) for x, y in self.low_rank])

    def __mul__(self, factor: float) -> SparseLR:
        told = [(x.select("id", (F.col("value") * factor).alias("value")), y) for x, y in self.low_rank]
        return SparseLR(self.edges.withColumn("weight", F.col("weight") * factor), self.n_row, self.n_col, told)

    __rmul__ = __mul__

    def __neg__(self) -> SparseLR:
        return self * -1.0

    def __add__(self, other: SparseLR | Graph) -> SparseLR:
        merged = self.edges.select("src", "dst", "weight").unionByName(other.edges.select("src", "dst", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        return SparseLR(merged, self.n_row, self.n_col, self.low_rank + getattr(other, "low_rank", []))

    def __sub__(self, other: SparseLR | Graph) -> SparseLR:
        return self + SparseLR(other.edges, self.n_row, self.n_col, getattr(other, "low_rank", [])) * -1.0

    def scaled(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> SparseLR:
        """Rows and columns times vectors (id, value); absent ids vanish."""
        edges, pairs = self.edges, self.low_rank
        times = lambda v, s: v.join(s.withColumnRenamed("value", "s"), "id").select("id", (F.col("value") * F.col("s")).alias("value"))
        for side, by, scale in (("src", 0, rows), ("dst", 1, cols)):
            if scale is not None:
                edges = edges.join(scale.select(F.col("id").alias(side), F.col("value").alias("s")), side).select("src", "dst", (F.col("weight") * F.col("s")).alias("weight"))
                pairs = [tuple(times(v, scale) if i == by else v for i, v in enumerate(p)) for p in pairs]
        return SparseLR(edges, self.n_row, self.n_col, pairs)

    def dot(self, block: DataFrame) -> DataFrame:
        """The product with a block of n_col rows, with all n_row rows."""
        names = columns_of(block)
        told = self.spark.range(self.n_row).join(dot_columns(self.edges, block), "id", "left").na.fill(0.0)
        for x, y in self.low_rank:
            sums = gram(y, block)[0]
            told = told.join(x.select("id", F.col("value").alias("lr")), "id", "left")
            told = told.select("id", *[(F.col(c) + F.coalesce("lr", F.lit(0.0)) * float(s)).alias(c) for c, s in zip(names, sums)])
        return told

    def right_sparse_dot(self, other: Graph) -> SparseLR:
        """Times a sparse matrix on the right."""
        return SparseLR(_product(self.edges, other.edges), self.n_row, other.n_col, [(x, dot_values(other.transpose().edges, y)) for x, y in self.low_rank])

    def left_sparse_dot(self, other: Graph) -> SparseLR:
        """Times a sparse matrix on the left."""
        return SparseLR(_product(other.edges, self.edges), other.n_row, self.n_col, [(dot_values(other.edges, x), y) for x, y in self.low_rank])

    def sum(self, axis: int | None = None):
        """Of all entries, or (id, value) of each column (0) or row (1)."""
        one = ones(self.spark, self.n_row if axis == 0 else self.n_col)
        told = (self.T if axis == 0 else self).dot(one.withColumnRenamed("value", "v0")).withColumnRenamed("v0", "value")
        return told if axis is not None else told.agg(F.sum("value")).first()[0] or 0.0

    def dense(self) -> np.ndarray:
        rows = self.edges.select("src", "dst", "weight").toPandas()  # DENSE cells at most
        out = np.zeros(self.shape)
        np.add.at(out, (rows["src"].to_numpy(np.int64), rows["dst"].to_numpy(np.int64)), rows["weight"].to_numpy(float))
        for x, y in self.low_rank:
            out += np.outer(vector(x, self.n_row), vector(y, self.n_col))
        return out


def ones(spark: SparkSession, n: int, value: float = 1.0) -> DataFrame:
    return spark.range(n).select("id", F.lit(float(value)).alias("value"))


def dot_values(edges: DataFrame, x: DataFrame) -> DataFrame:
    return dot_columns(edges, x)


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("weight").alias("w"))
    met = a.join(other, F.col("dst") == F.col("mid"))
    return met.groupBy("src", F.col("end").alias("dst")).agg(F.sum(F.col("weight") * F.col("w")).alias("weight"))


def matrix(graph: Graph) -> SparseLR:
    return SparseLR(graph.edges, graph.n_row, graph.n_col)


def regularizer(graph: Graph, regularization: float = 1) -> SparseLR:
    """Each entry plus regularization / n_col."""
    spark = graph.edges.sparkSession
    pair = (ones(spark, graph.n_row, regularization / graph.n_col), ones(spark, graph.n_col))
    return SparseLR(graph.edges, graph.n_row, graph.n_col, [pair] if regularization else [])


def pseudo_inverse(values: DataFrame, power: float = 1.0) -> DataFrame:
    """(id, 1 / value ** power), rows of value 0 left out."""
    return values.where("value != 0").select("id", (1 / F.pow("value", F.lit(float(power)))).alias("value"))


def normalizer(graph: Graph, regularization: float = 0) -> SparseLR:
    """The regularised matrix with rows that sum to 1; null rows stay null."""
    told = regularizer(graph, regularization)
    return told.scaled(rows=settled(pseudo_inverse(told.sum(axis=1))))


def laplacian_operator(graph: Graph, regularization: float = 0, normalized: bool = False) -> tuple[SparseLR, DataFrame | None]:
    """The Laplacian of the regularised graph, and the scale (id, value) that it was normalised by."""
    told = regularizer(graph, regularization)
    degree = settled(told.sum(axis=1))
    diagonal = degree.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("value").alias("weight"))
    whole = SparseLR(diagonal, graph.n_row, graph.n_row) - told
    if not normalized:
        return whole, None
    scale = settled(pseudo_inverse(degree, 0.5))
    return whole.scaled(scale, scale), scale


def co_neighbors(graph: Graph, normalized: bool = True) -> SparseLR:
    """Rows joined by what they share: A F A', F the inverse of the column sums or, not normalised, the identity."""
    turned = matrix(graph.transpose())
    if normalized:
        turned = turned.scaled(rows=pseudo_inverse(matrix(graph).sum(axis=0)))
    return SparseLR(_product(graph.edges, turned.edges), graph.n_row, graph.n_row)


@dataclass
class Polynome:
    """c0 + c1 M + c2 M^2 + ..., as products by Horner's scheme."""

    matrix: SparseLR
    coeffs: list[float]

    def __mul__(self, factor: float) -> Polynome:
        return Polynome(self.matrix, [c * factor for c in self.coeffs])

    __rmul__ = __mul__

    def __neg__(self) -> Polynome:
        return self * -1.0

    @property
    def T(self) -> Polynome:  # noqa: N802
        return Polynome(self.matrix.T, self.coeffs)

    def dot(self, block: DataFrame) -> DataFrame:
        names = columns_of(block)
        told = block.select("id", *[(F.col(c) * float(self.coeffs[-1])).alias(c) for c in names])
        for c in self.coeffs[-2::-1]:
            other = block.select("id", *[(F.col(n) * float(c)).alias(f"b_{n}") for n in names])
            told = settled(self.matrix.dot(told).join(other, "id").select("id", *[(F.col(n) + F.col(f"b_{n}")).alias(n) for n in names]))
        return told


def random_block(spark: SparkSession, n: int, k: int, seed: int = 42) -> DataFrame:
    """Numbers between -1 and 1, told by a hash of id, column and seed, so reruns agree."""
    return spark.range(n).select("id", *[(F.xxhash64("id", F.lit(j), F.lit(seed)) / float(1 << 63)).alias(f"v{j}") for j in range(k)])


def orthonormal(block: DataFrame) -> DataFrame:
    """A basis of the space that the columns span, as far as they are independent; two passes for accuracy."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(gram(block))
        keep = values > values.max() * 1e-13
        block = settled(mixed(block, vectors[:, keep] / np.sqrt(values[keep])))
    return block


def _frame(spark: SparkSession, array: np.ndarray) -> DataFrame:
    k = array.shape[1]
    schema = ", ".join(["id bigint", *[f"v{j} double" for j in range(k)]])
    return as_rows(spark, schema, np.arange(len(array)), *array.T)


class EigSolver:
    """Eigenvalues and vectors of a symmetric matrix.  which: LM, the largest by size, or SM, the smallest of one that has none below 0."""

    def __init__(self, which: str = "LM", n_iter: int = 200, tol: float = 1e-9, seed: int = 42):
        self.which, self.n_iter, self.tol, self.seed = which, n_iter, tol, seed

    def fit(self, matrix: SparseLR, n_components: int = 2) -> EigSolver:
        if matrix.n_row * matrix.n_col <= DENSE:
            values, vectors = np.linalg.eigh(matrix.dense())
            order = np.argsort(np.abs(values))
            order = order[:n_components] if self.which == "SM" else order[::-1][:n_components]
            self.eigenvalues_, self.eigenvectors_ = values[order], _frame(matrix.spark, vectors[:, order])
            return self
        # the smallest are the largest of a shifted matrix; the row sums of sizes bound the spectrum
        shift = 0.0
        if self.which == "SM":
            low = sum((x.agg(F.max(F.abs("value"))).first()[0] or 0.0) * (y.agg(F.sum(F.abs("value"))).first()[0] or 0.0) for x, y in matrix.low_rank)
            shift = low + (matrix.edges.groupBy("src").agg(F.sum(F.abs("weight")).alias("s")).agg(F.max("s")).first()[0] or 0.0)
        block, before = orthonormal(random_block(matrix.spark, matrix.n_row, n_components + 8, self.seed)), None
        for _ in range(self.n_iter):
            image = settled(matrix.dot(block))
            values, vectors = np.linalg.eigh((lambda t: (t + t.T) / 2)(gram(block, image)))
            order = (np.argsort(values) if self.which == "SM" else np.argsort(-np.abs(values)))[:n_components]
            if before is not None and np.abs(values[order] - before).max() <= self.tol * max(1.0, np.abs(values).max()):
                break
            before = values[order]
            if shift:
                names = columns_of(block)
                other = block.select("id", *[(F.col(c) * shift).alias(f"b_{c}") for c in names])
                image = image.join(other, "id").select("id", *[(F.col(f"b_{c}") - F.col(c)).alias(c) for c in names])
            block = orthonormal(settled(image))
            image = None
        self.eigenvalues_, self.eigenvectors_ = values[order], settled(mixed(block, vectors[:, order]))
        return self


class SVDSolver:
    """The largest singular values with their vectors, in decreasing order."""

    def __init__(self, n_iter: int = 100, tol: float = 1e-9, seed: int = 42):
        self.n_iter, self.tol, self.seed = n_iter, tol, seed

    def fit(self, matrix: SparseLR, n_components: int = 2) -> SVDSolver:
        if matrix.n_row * matrix.n_col <= DENSE:
            u, s, v = np.linalg.svd(matrix.dense(), full_matrices=False)
            k = n_components
            self.singular_values_ = s[:k]
            self.singular_vectors_left_, self.singular_vectors_right_ = _frame(matrix.spark, u[:, :k]), _frame(matrix.spark, v[:k].T)
            return self
        turned, before = matrix.T, None
        right = orthonormal(random_block(matrix.spark, matrix.n_col, n_components + 8, self.seed))
        for _ in range(self.n_iter):
            left = settled(matrix.dot(right))
            values, vectors = np.linalg.eigh(gram(left))
            order = np.argsort(-values)[:n_components]
            s = np.sqrt(np.maximum(values[order], 0))
            if before is not None and np.abs(s - before).max() <= self.tol * max(s.max(), 1e-300):
                break
            before = s
            right = orthonormal(settled(turned.dot(left)))
        else:
            left = settled(matrix.dot(right))
            values, vectors = np.linalg.eigh(gram(left))
            order = np.argsort(-values)[:n_components]
            s = np.sqrt(np.maximum(values[order], 0))
        self.singular_values_ = s
        self.singular_vectors_right_ = settled(mixed(right, vectors[:, order]))
        self.singular_vectors_left_ = settled(mixed(left, vectors[:, order] / np.where(s > 0, s, 1)))
        return self
