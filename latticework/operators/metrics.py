"""Accuracy and F1 of predicted labels: tables (id, label), negative labels unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import confusion_matrix, f1_scores


def paired(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label_true, label_pred) of every node."""
    return true.select("id", F.col("label").alias("label_true")).join(predicted.select("id", F.col("label").alias("label_pred")), "id").drop("id")


def _known(true: DataFrame, predicted: DataFrame) -> DataFrame:
    return paired(true, predicted).where("label_true >= 0 and label_pred >= 0").select(F.col("label_true").alias("t"), F.col("label_pred").alias("p"))


def accuracy(true: DataFrame, predicted: DataFrame) -> float:
    """Share of equal labels among nodes whose two labels are known; ValueError if there is none."""
    told = _known(true, predicted).agg(F.avg((F.col("t") == F.col("p")).cast("double"))).first()[0]
    if told is None:
        raise ValueError("no node has both labels")
    return told


def f1_score(true: DataFrame, predicted: DataFrame) -> tuple[float, float, float]:
    """(F1, precision, recall) of label 1 against 0; ValueError if the true labels aren't both of these and no others."""
    if {r[0] for r in true.where("label >= 0").select("label").distinct().limit(3).collect()} != {0, 1}:
        raise ValueError("the labels have to be 0 and 1")
    row = f1_scores(paired(true, predicted)).where("label = 1").first()
    return row["f1"], row["precision"], row["recall"]


def average_f1(true: DataFrame, predicted: DataFrame, average: str = "macro") -> float:
    """macro: plain mean over labels; weighted: by the labels' true counts, nodes without a predicted label included; micro: the accuracy."""
    if average == "micro":
        return accuracy(true, predicted)
    scores = f1_scores(paired(true, predicted))
    if average == "macro":
        return scores.agg(F.avg("f1")).first()[0]
    if average == "weighted":
        counts = true.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"))
        told = counts.join(scores, "label", "left").agg(F.sum(F.coalesce("f1", F.lit(0.0)) * F.col("n")) / F.sum("n"), F.count("f1")).first()
        return told[0] if told[1] else None
    raise ValueError(f"average is 'macro', 'micro' or 'weighted', not {average!r}")


__all__ = ["accuracy", "average_f1", "confusion_matrix", "f1_score", "f1_scores", "paired"]
