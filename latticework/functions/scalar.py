"""Functions of numbers and of arrays of numbers, and the losses built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probabilities are kept so far from 0 and 1 before their logarithm is taken.
CLIP = 1e-10


def pseudo_inverse(x: Column) -> Column:
    return F.when(x != 0, 1 / x).otherwise(0.0)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def relu_gradient(x: Column, direction: Column) -> Column:
    return direction * (x > 0).cast("double")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoid_gradient(x: Column, direction: Column) -> Column:
    y = sigmoid(x)
    return y * (1 - y) * direction


def softmax(x: Column) -> Column:
    """Of an array; shifted by its largest entry, so that none overflows."""
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(shifted, lambda v: v / total(shifted))


def softmax_gradient(x: Column, direction: Column) -> Column:
    y = softmax(x)
    return F.zip_with(y, direction, lambda p, d: p * (d - dot(y, direction)))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column, p: int = 2) -> Column:
    return F.sqrt(dot(x, x)) if p == 2 else total(F.transform(x, F.abs))


def cosine(x: Column, y: Column) -> Column:
    """0 where a vector is null."""
    both = norm(x) * norm(y)
    return F.when(both > 0, dot(x, y) / both).otherwise(0.0)


def euclidean(x: Column, y: Column) -> Column:
    return norm(F.zip_with(x, y, lambda a, b: a - b))


def normalized(x: Column, p: int = 2) -> Column:
    """An array over its norm; a null one stays."""
    return F.when(norm(x, p) > 0, F.transform(x, lambda v: v / norm(x, p))).otherwise(x)


def clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))


def cross_entropy(table: DataFrame, probs: str = "probs", label: str = "label") -> DataFrame:
    """One row, loss: the mean of -log of the probability, an entry of an array, of each row's label."""
    return table.agg(F.avg(-F.log(clipped(F.get(F.col(probs), F.col(label).cast("int"))))).alias("loss"))


def binary_cross_entropy(table: DataFrame, probs: str = "probs", label: str = "label") -> DataFrame:
    """One row, loss: the mean over rows of the sum over classes, each a question of its own; one class is told by label 0 or 1."""
    p, y = F.col(probs), F.col(label)
    hit = lambda i: F.when(F.size(p) == 1, y == 1).otherwise(y == i)
    each = F.transform(p, lambda v, i: -F.log(F.when(hit(i), clipped(v)).otherwise(clipped(1 - v))))
    return table.agg(F.avg(total(each)).alias("loss"))


def min_max_scaled(table: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """The column scaled to 0..1 between the given bounds, or its own; 0.5 where these are equal."""
    least, most = table.agg(F.min(column), F.max(column)).first()
    least, most = (least if low is None else low), (most if high is None else high)
    scaled = F.lit(0.5) if least == most else (F.col(column) - least) / (most - least)
    return table.withColumn(column, scaled)


def cumulative_sums(x: Column) -> Column:
    """Sums of an array's first entries."""
    return F.transform(x, lambda _, i: total(F.slice(x, F.lit(1), i + 1)))


def nonzero(x: Column) -> Column:
    """Places of the entries that aren't 0."""
    return F.filter(F.transform(x, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())


def rolled(x: Column, k: int) -> Column:
    """The array moved by k places, the end becoming the beginning."""
    n = F.size(x)
    at = F.pmod(-F.lit(k), F.greatest(n, F.lit(1)))
    return F.concat(F.slice(x, at + 1, n), F.slice(x, F.lit(1), at))


def stacked(columns: list[Column]) -> Column:
    return F.array(*columns)


def xml_text(x: Column) -> Column:
    """A string without the characters that markup gives a meaning to."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), "&<>", x)
