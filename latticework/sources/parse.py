"""Graphs from edge lists, adjacency lists, CSV and GraphML files, and the small files that go with them.

Rows are read and joined by Spark; only a file's first lines and its header of attribute keys come to the driver.  Edges that
repeat add up, or the first one stays.  Ids that are whole numbers stay as they are unless reindex is set, others are numbered in the
order of their names.  An undirected graph is the sum of both directions, so a pair that is listed both ways weighs double.
"""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, directed2undirected
from ..operators.loops import settled
from .dataset import Dataset, exists, load, save
from .tables import numbered


def is_number(column) -> F.Column:
    """Whether a string reads as a number."""
    return F.expr(f"try_cast({column} AS double)").isNotNull() if isinstance(column, str) else column.try_cast("double").isNotNull()


def graphml_type(name: str) -> str | None:
    """The Spark type of a GraphML attribute type."""
    return {"boolean": "boolean", "int": "int", "long": "double", "float": "double", "double": "double", "string": "string"}.get(name)


def from_edges_table(edges: DataFrame, directed: bool = False, bipartite: bool = False, weighted: bool = True, reindex: bool = False, shape: tuple[int, int] | None = None, sum_duplicates: bool = True) -> Dataset:
    """edges(src, dst [, weight] [, at]), at telling which of two equal edges is first -> graph and, where ids are names, the names.

    shape only enlarges.  A weight that isn't a number raises ValueError; rows without source or target are left out.
    """
    if "at" not in edges.columns:
        edges = edges.withColumn("at", F.monotonically_increasing_id())
    given = weighted and "weight" in edges.columns
    edges = edges.where("src is not null and dst is not null")
    if given and not edges.where(F.col("weight").isNotNull() & F.col("weight").cast("string").try_cast("double").isNull()).isEmpty():
        raise ValueError("weights have to be numbers")
    edges = settled(edges.select("at", "src", "dst", (F.col("weight").cast("string").try_cast("double") if given else F.lit(1.0)).alias("weight")))
    whole = [F.col(c).cast("string").try_cast("bigint") for c in ("src", "dst")]
    numeric = edges.where(whole[0].isNull() | whole[1].isNull()).isEmpty()
    told = Dataset()
    if numeric:
        edges = edges.select("at", whole[0].alias("src"), whole[1].alias("dst"), "weight")
    if reindex or not numeric:
        left, right = edges.select(F.col("src").alias("name")), edges.select(F.col("dst").alias("name"))
        rows = settled(numbered((left if bipartite else left.unionByName(right)).distinct()))
        cols = settled(numbered(right.distinct())) if bipartite else rows
        edges = edges.join(rows.select(F.col("id").alias("a"), F.col("name").alias("src")), "src").join(cols.select(F.col("id").alias("b"), F.col("name").alias("dst")), "dst")
        edges = edges.select("at", F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
        n_row, n_col = rows.count(), cols.count()
        told["names"] = rows
        if bipartite:
            told |= {"names_row": rows, "names_col": cols}
    else:
        last = edges.agg(F.max("src"), F.max("dst")).first()
        n_row, n_col = (-1 if x is None else x for x in last)
        n_row, n_col = (n_row + 1, n_col + 1) if bipartite else [max(n_row, n_col) + 1] * 2
    if shape is not None:
        n_row, n_col = max(n_row, shape[0]), max(n_col, shape[1])
        if not bipartite:
            n_row = n_col = max(n_row, n_col)
    one = F.lit(1.0) if not weighted else F.sum("weight") if sum_duplicates else F.min_by("weight", "at")
    merged = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), one.alias("weight")).drop("n")
    graph = Graph(merged, n_row, n_col, bipartite)
    told["graph"] = graph if directed or bipartite else directed2undirected(graph)
    return told


def from_edge_array(spark: SparkSession, edge_array, weights=None, **how) -> Dataset:
    """Pairs of ids or names, and their weights."""
    pairs = [tuple(p)[:2] for p in edge_array]
    if any(len(p) != 2 for p in pairs):
        raise ValueError("edges are pairs")
    names = any(isinstance(x, str) for p in pairs for x in p)
    rows = [(i, *((str(x) if names else int(x)) for x in p), float(1 if weights is None else weights[i])) for i, p in enumerate(pairs)]
    kind = "string" if names else "bigint"
    return from_edges_table(spark.createDataFrame(rows, f"at bigint, src {kind}, dst {kind}, weight double"), **how)


def from_edge_list(spark: SparkSession, edge_list, **how) -> Dataset:
    """Tuples of two ids or names, or of three, the last a weight; all of one length."""
    edges = [tuple(e) for e in edge_list]
    lengths = {len(e) for e in edges}
    if lengths - {2, 3} or len(lengths) > 1:
        raise ValueError("edges are tuples of two or three, all alike")
    return from_edge_array(spark, [e[:2] for e in edges], [e[2] for e in edges] if lengths == {3} else None, **how)


def from_adjacency_list(spark: SparkSession, adjacency_list, **how) -> Dataset:
    """Lists of neighbours, the place of a list being its source; or a dict from sources to lists."""
    pairs = adjacency_list.items() if isinstance(adjacency_list, dict) else enumerate(adjacency_list)
    if not isinstance(adjacency_list, (dict, list, tuple)):
        raise TypeError("adjacency lists are a list of lists or a dict")
    return from_edge_list(spark, [(i, j) for i, near in pairs for j in near], **how)


def scan_header(spark: SparkSession, path: str, delimiters: str = "\t,; ", comments: str = "#%", n_scan: int = 100) -> tuple[int, str, str, str]:
    """(lines of the header, delimiter, comment character, structure), guessed from a file's first lines.

    The delimiter is the one that all rows hold equally often, or the commonest; rows of two or three cells are an edge list.
    """
    head, n, comment, rows = spark.read.text(path), 0, comments[0], []
    for row in head.limit(n_scan + 1000).toLocalIterator():  # bounded, and read until n_scan rows are seen
        line = row["value"]
        if line[:1] in tuple(comments):
            n, comment = n + 1, line[0]
        elif len(rows) < n_scan:
            rows.append(line.rstrip())
        else:
            break
    counts = {d: [r.count(d) for r in rows] for d in delimiters}
    even = [d for d in delimiters if rows and min(counts[d]) == max(counts[d]) > 0]
    delimiter = even[0] if len(even) == 1 else max(delimiters, key=lambda d: sum(counts[d]))
    sizes = {len(r.split(delimiter)) for r in rows}
    return n, delimiter, comment, "edge_list" if sizes in ({2}, {3}) else "adjacency_list"


def from_csv(spark: SparkSession, path: str, delimiter: str | None = None, sep: str | None = None, comments: str = "#%", data_structure: str | None = None, **how) -> Dataset:
    """A file of edges or of adjacency lists; delimiter and structure are guessed where they aren't given.

    data_structure: edge_list, adjacency_list (the place of a line is its source) or adjacency_dict (its first cell is).  Lines that begin
    with a comment character, and empty ones at an edge list's end, are left out.
    """
    _, guess, _, structure = scan_header(spark, path, delimiters=delimiter or sep or "\t,; ", comments=comments)
    delimiter, structure = delimiter or sep or guess, data_structure or structure
    cells = F.split("value", "\\Q" + delimiter + "\\E", -1)
    lines = spark.read.text(path).where(~F.substring("value", 1, 1).isin(list(comments))).select(F.monotonically_increasing_id().alias("at"), F.rtrim("value").alias("value"))
    if structure == "edge_list":
        rows = lines.where("value != ''").select("at", cells.alias("c"))
        width = rows.agg(F.min(F.size("c")), F.max(F.size("c"))).first()
        if width[0] != width[1] or width[0] not in (2, 3):
            raise ValueError("an edge list has two or three cells in every row")
        cell = [F.col("c")[i] for i in range(width[0])]
        if rows.where(F.exists("c", lambda x: x.try_cast("double").isNull())).isEmpty():
            cell[:2] = [x.try_cast("double").cast("bigint").cast("string") for x in cell[:2]]  # ids such as 1.0 are whole
        return from_edges_table(rows.select("at", *[x.alias(n) for x, n in zip(cell, ("src", "dst", "weight"))]), **how)
    if structure not in ("adjacency_list", "adjacency_dict"):
        raise ValueError(f"no such structure: {structure}")
    rows = lines.select("at", cells.alias("c"))
    if structure == "adjacency_list":
        order = numbered(rows.select(F.col("at").alias("name")))
        rows = rows.join(order.select(F.col("name").alias("at"), F.col("id").cast("string").alias("src")), "at")
    else:
        rows = rows.select("at", F.col("c")[0].alias("src"), F.slice("c", F.lit(2), F.size("c")).alias("c"))
    each = rows.select("src", F.posexplode("c").alias("place", "dst"), "at").where("dst != ''")
    return from_edges_table(each.select("src", "dst", F.struct("at", "place").alias("at")), **how)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): one label a line, blanks around it left out."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("label"))
    order = numbered(rows.select(F.col("at").alias("name")))
    return rows.join(order.withColumnRenamed("name", "at"), "at").select("id", "label")


def load_header(spark: SparkSession, path: str) -> tuple[bool, bool, bool]:
    """(directed, bipartite, weighted), from the words asym, bip and unweighted in a file's first line."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    return "asym" in line, "bip" in line, "unweighted" not in line


def load_metadata(spark: SparkSession, path: str, delimiter: str = ": ") -> Dataset:
    """A small file of keys and values, a pair a line."""
    told = Dataset()
    for row in spark.read.text(path).toLocalIterator():
        key, _, value = row["value"].partition(delimiter)
        told[key] = value
    return told


def from_graphml(spark: SparkSession, path: str, weight_key: str = "weight") -> Dataset:
    """graph, names (unless ids are canonical), node_attribute(id, ...), edge_attribute(src, dst, ...) and meta of a GraphML file.

    Everything before the graph element (keys, defaults, descriptions) is parsed on the driver, nodes and edges by Spark's XML
    reader.  An undirected edge is stored both ways.  A file without a graph raises ValueError.
    """
    tags = spark.read.text(path, lineSep=">").select(F.monotonically_increasing_id().alias("at"), "value")
    begin = tags.where(F.col("value").rlike(r"^\s*<([\w.-]+:)?graph(\s|$)")).agg(F.min("at")).first()[0]
    if begin is None:
        raise ValueError(f"no graph in {path}")
    head = ">".join(r["value"] for r in tags.where(F.col("at") <= begin).orderBy("at").collect())  # keys only
    root = ElementTree.fromstring((head.rstrip("/") + "/></graphml>").encode())
    plain = lambda e: e.tag.rpartition("}")[2]
    graph = next(e for e in root if plain(e) == "graph")
    child = lambda e, name: next((c.text for c in e if plain(c) == name), None)
    both, canonical = graph.get("edgedefault") == "undirected", graph.get("parse.nodeids") == "canonical"
    keys = [(e.get("id"), e.get("attr.name"), graphml_type(e.get("attr.type")), e.get("for"), child(e, "default"), child(e, "desc")) for e in root if plain(e) == "key"]
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema + ", data array<struct<_VALUE string, _key string>>").load(path)
    zero = {"string": "", "boolean": "false", "int": "0", "double": "0"}

    def value(key: tuple, default: str | None) -> F.Column:
        found = F.get(F.filter("data", lambda d: d["_key"] == key[0]), F.lit(0))["_VALUE"]
        return F.coalesce(found, F.lit(default if default is not None else zero[key[2]])).cast(key[2]).alias(key[1])

    of = lambda kind: [value(k, k[4]) for k in keys if k[3] == kind and k[1] != weight_key]
    told = Dataset()
    nodes = settled(read("node", "_id string").withColumn("at", F.monotonically_increasing_id()))
    if canonical:
        number = lambda c: F.substring(c, 2, 20).cast("bigint")
        nodes = nodes.withColumn("id", number("_id"))
    else:
        order = numbered(nodes.select(F.col("at").alias("name")))
        nodes = nodes.join(order.withColumnRenamed("name", "at"), "at")
        told["names"] = nodes.select("id", F.col("_id").alias("name"))
    if of("node"):
        told["node_attribute"] = nodes.select("id", *of("node"))
    weight = next((value(k, k[4] or "1").cast("double") for k in keys if k[1] == weight_key), F.lit(1.0))
    edges = read("edge", "_source string, _target string, _directed string")
    edges = edges.select("_source", "_target", (F.coalesce(F.col("_directed") != "true", F.lit(both))).alias("both"), weight.alias("weight"), *of("edge"))
    if canonical:
        edges = edges.withColumns({"src": number("_source"), "dst": number("_target")})
    else:
        ids = nodes.select("_id", "id")
        edges = edges.join(ids.select(F.col("_id").alias("_source"), F.col("id").alias("src")), "_source").join(ids.select(F.col("_id").alias("_target"), F.col("id").alias("dst")), "_target")
    names = [k[1] for k in keys if k[3] == "edge" and k[1] != weight_key]
    stored = edges.select("src", "dst", "weight", *names).unionByName(edges.where("both").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", *names))
    stored = settled(stored)
    n = nodes.count()
    told["graph"] = Graph(stored.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), n, n)
    if names:
        told["edge_attribute"] = stored.select("src", "dst", *names)
    words = {kind: {k[1]: k[5] for k in keys if k[3] == kind and k[5]} for kind in ("node", "edge")}
    if child(root, "desc") or any(words.values()):
        told["meta"] = Dataset(description=child(root, "desc"), attributes=Dataset({k: Dataset(v) for k, v in words.items()}))
    return told


def load_konect(spark: SparkSession, folder: str, cache: str | None = None) -> Dataset:
    """A folder with files out.NAME (edges), meta.NAME and ent.NAME.* (labels), as Konect's archives hold; with cache, kept there."""
    if cache and exists(spark, f"{cache}/meta"):
        return load(spark, cache)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().toString() for f in files.listStatus(target)] if files.exists(target) else []
    name = lambda p: p.rsplit("/", 1)[1]
    edges = next((p for p in found if name(p).startswith("out.")), None)
    if edges is None:
        raise ValueError(f"no edges in {folder}")
    directed, bipartite, weighted = load_header(spark, edges)
    told = from_csv(spark, edges, data_structure=None, directed=directed, bipartite=bipartite, weighted=weighted, reindex=True)
    for p in found:
        if name(p).startswith("meta."):
            told["meta"] = dict(load_metadata(spark, p))
        elif name(p).startswith("ent."):
            told["_".join(name(p).split(".")[1:])] = load_labels(spark, p)
    if cache:
        save(spark, cache, told)
    return told


def load_netset(spark: SparkSession, folder: str) -> Dataset:
    """A bundle that save() wrote, from a local or shared folder; there is no download."""
    return load(spark, folder)
