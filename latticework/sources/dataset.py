"""A dataset: named parts of one graph (its edges, names, labels, positions), reachable as attributes, kept in a folder.

Parts are graphs, DataFrames, or small plain values.  Graphs and DataFrames are stored as Parquet, plain values as JSON; nothing
is pickled.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph
from . import tables


class Dataset(dict):
    """Parts by name, also as attributes."""

    def __getattr__(self, name: str):
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e

    __setattr__ = dict.__setitem__
    __delattr__ = dict.__delitem__


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, path)
    files.delete(target, True)


def save(spark: SparkSession, folder: str, data: Graph | DataFrame | dict) -> None:
    """A graph, a table or a dataset to a folder, in place of what is there."""
    if not isinstance(data, dict):
        data = {"graph" if isinstance(data, Graph) else "table": data}
    if exists(spark, folder):
        delete(spark, folder)
    plain, kinds = {}, {}
    for name, part in data.items():
        if isinstance(part, Graph):
            kinds[name] = "graph"
            tables.save(part, f"{folder}/{name}")
        elif isinstance(part, DataFrame):
            kinds[name] = "table"
            part.write.parquet(f"{folder}/{name}")
        else:
            plain[name] = part
    spark.createDataFrame([(json.dumps({"kinds": kinds, "plain": plain}),)], "value string").coalesce(1).write.text(f"{folder}/meta")


def load(spark: SparkSession, folder: str) -> Dataset:
    """What save() wrote; FileNotFoundError where nothing is."""
    if not exists(spark, f"{folder}/meta"):
        raise FileNotFoundError(folder)
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    found = Dataset(meta["plain"])
    for name, kind in meta["kinds"].items():
        found[name] = tables.load(spark, f"{folder}/{name}") if kind == "graph" else spark.read.parquet(f"{folder}/{name}")
    return found


def data_home(home: str | None = None) -> str:
    """The folder for bundles: the argument, the variable LATTICEWORK_DATA, or one in the user's home."""
    return home or os.environ.get("LATTICEWORK_DATA") or os.path.join(os.path.expanduser("~"), "latticework_data")


def save_bundle(spark: SparkSession, data: Graph | DataFrame | dict, name: str, home: str | None = None) -> None:
    save(spark, f"{data_home(home)}/{name}", data)


def load_bundle(spark: SparkSession, name: str, home: str | None = None) -> Dataset:
    return load(spark, f"{data_home(home)}/{name}")


def clear_data_home(spark: SparkSession, home: str | None = None) -> None:
    """The folder goes, with all in it."""
    delete(spark, data_home(home))


def clean_data_home(spark: SparkSession, home: str | None = None) -> None:
    """The bundles go, the folder stays."""
    target, files = _file_system(spark, data_home(home))
    if files.exists(target):
        for entry in files.listStatus(target):
            files.delete(entry.getPath(), True)
