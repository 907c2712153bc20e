"""An extension: degrees and weights of a graph whose edges arrive as a stream.  The operators themselves take whole graphs.

Each micro-batch becomes one Parquet table of changes per node, named by its batch id and written anew if the batch is run again, so
a restart counts nothing twice; the sum over the tables is the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _changes(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("side"), "weight"), F.struct(F.col("dst").alias("id"), F.lit("in").alias("side"), "weight"))).alias("e"))
    return ends.groupBy("e.id", "e.side").agg(F.count("*").alias("degree"), F.sum("e.weight").alias("weight"))


def stream_degrees(edges: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """edges(src, dst, weight) of a streaming DataFrame -> the running query; merge_degrees(path) reads what it has counted."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        _changes(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = edges.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merge_degrees(spark: SparkSession, path: str) -> DataFrame:
    """(id, side, degree, weight) over all batches so far."""
    return spark.read.parquet(path).groupBy("id", "side").agg(F.sum("degree").alias("degree"), F.sum("weight").alias("weight"))
