"""Iteration policy: a loop's state is written to the shared folder each round, which keeps plans short and lets a lost
executor cost one round.

State is a Parquet table rather than a checkpoint: it is computed once, not once to count and once to write, and its size
is known to the planner, which then broadcasts it as long as it is small and shuffles it beyond that.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only where none is named and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="latticework-"))
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; a session that has ended leaves it."""
    if spark.sparkContext._jsc is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def watched(df: DataFrame, old: DataFrame | None = None, **sums) -> tuple[DataFrame, dict[str, float]]:
    """settled(), and sums over its rows that are taken while they are written."""
    seen = Observation()
    kept = settled(df.observe(seen, *[F.sum(expression).alias(name) for name, expression in sums.items()]), old)
    return kept, {name: value or 0.0 for name, value in seen.get.items()}


def settled(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The rows, read from the shared folder.  old: an earlier result that nothing reads any more; its folder goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._state_path = path
    if gone := getattr(old, "_state_path", None):
        remove(spark, gone)
    return kept
