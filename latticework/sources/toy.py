"""Small graphs that are known by heart, as literal tables.

Each function gives the graph, or with metadata=True a Dataset that also holds names, labels or positions.  Tables of over
200 entries aren't built in: miserables() and art_philo_science() read them from files whose path is an argument.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, directed2undirected, from_biadjacency, from_edges
from . import tables
from .dataset import Dataset

# The edges of published toy graphs, their names, labels and positions.
HOUSE = "0 1, 0 4, 1 2, 1 4, 2 3, 3 4"
HOUSE_POSITION = "0 2, -1 1, -1 -1, 1 -1, 1 1"
BOW_TIE = "0 1, 0 2, 0 3, 0 4, 1 2, 3 4"
BOW_TIE_POSITION = "0 0, -1 1, 1 1, -1 -1, 1 -1"
KARATE_CLUB = """0 1, 0 2, 0 3, 0 4, 0 5, 0 6, 0 7, 0 8, 0 10, 0 11, 0 12, 0 13, 0 17, 0 19, 0 21, 0 31, 1 2, 1 3, 1 7, 1 13, 1 17,
1 19, 1 21, 1 30, 2 3, 2 7, 2 8, 2 9, 2 13, 2 27, 2 28, 2 32, 3 7, 3 12, 3 13, 4 6, 4 10, 5 6, 5 10, 5 16, 6 16, 8 30, 8 32,
8 33, 9 33, 13 33, 14 32, 14 33, 15 32, 15 33, 18 32, 18 33, 19 33, 20 32, 20 33, 22 32, 22 33, 23 25, 23 27, 23 29, 23 32,
23 33, 24 25, 24 27, 24 31, 25 31, 26 29, 26 33, 27 33, 28 31, 28 33, 29 32, 29 33, 30 32, 30 33, 31 32, 31 33, 32 33"""
KARATE_CLUB_LABELS = "1 1 1 1 1 1 1 1 1 0 1 1 1 1 0 0 1 1 0 1 0 1 0 0 0 0 0 0 0 0 0 0 0 0"
PAINTERS = """0 3, 0 10, 1 3, 1 12, 2 9, 3 0, 3 1, 3 7, 3 11, 3 12, 4 2, 4 5, 4 9, 5 2, 5 4, 5 8, 5 9, 6 0, 6 13, 7 1, 7 2, 7 3,
7 8, 7 11, 7 12, 8 0, 8 1, 8 4, 8 5, 8 7, 8 10, 8 11, 9 2, 9 4, 10 0, 10 3, 10 8, 10 11, 10 12, 11 0, 11 1, 11 3, 11 10,
11 12, 12 1, 12 3, 12 4, 12 7, 13 6, 13 8"""
PAINTERS_NAMES = """Pablo Picasso, Claude Monet, Michel Angelo, Edouard Manet, Peter Paul Rubens, Rembrandt, Gustav Klimt,
Edgar Degas, Vincent van Gogh, Leonardo da Vinci, Henri Matisse, Paul Cezanne, Pierre-Auguste Renoir, Egon Schiele"""
PAINTERS_POSITION = """0.24 0.53, -0.47 0.19, -0.3 -0.71, -0.31 0.44, -0.08 -0.48, 0.12 -0.65, 0.78 0.69, -0.36 -0.11, 0.11 0.01,
-0.06 -1, -0.02 0.49, -0.12 0.28, -0.24 0.06, 0.73 0.27"""
HOURGLASS = "0 0, 0 1, 1 0, 1 1"
STAR_WARS = "0 0, 0 2, 1 0, 2 0, 2 1, 2 2, 3 1, 3 2"
STAR_WARS_ROWS = "Jabba, Greedo, Vader, Boba"
STAR_WARS_COLS = "A New Hope, The Empire Strikes Back, Return Of The Jedi"
MOVIE_ACTOR = """0 0, 0 1, 0 2, 1 1, 1 2, 1 3, 2 3, 2 4, 2 5, 2 8, 3 4, 3 6, 4 0, 4 6, 5 4, 5 7, 6 4, 6 7, 6 8, 7 3, 7 8, 8 9,
8 10, 8 11, 8 12, 8 15, 9 0, 9 11, 9 12, 10 9, 10 10, 10 13, 10 16, 11 5, 11 9, 11 13, 12 1, 12 9, 12 15, 13 12, 13 14, 14 14,
14 16"""
MOVIE_ACTOR_ROWS = """Inception, The Dark Knight Rises, The Big Short, Drive, The Great Gatsby, La La Land, Crazy Stupid Love, Vice,
The Grand Budapest Hotel, Aviator, 007 Spectre, Inglourious Basterds, Midnight In Paris, Murder on the Orient Express,
Pirates of the Caribbean: At World's End"""
MOVIE_ACTOR_COLS = """Leonardo DiCaprio, Marion Cotillard, Joseph Gordon Lewitt, Christian Bale, Ryan Gosling, Brad Pitt,
Carey Mulligan, Emma Stone, Steve Carell, Lea Seydoux, Ralph Fiennes, Jude Law, Willem Dafoe, Christophe Waltz, Johnny Depp,
Owen Wilson, Naomie Harris"""
# Source, target and weight of small test graphs.
SMALL_DIGRAPH = "0 1 1, 1 4 1, 1 3 2.5, 3 2 1, 4 5 2, 6 4 2, 6 5 1, 6 7 2, 6 1 2, 7 9 1.5, 8 9 2, 8 2 1, 9 9 2"
SMALL_BIGRAPH = "0 1 1, 1 2 2.5, 1 3 1, 2 1 2, 2 0 2, 3 4 1.5, 4 7 1, 5 5 2, 5 6 3"
SMALL_DISCONNECTED = "1 1 1, 2 3 2.5, 3 2 1, 4 5 2, 6 4 2, 6 5 1, 6 7 2, 7 9 2, 8 9 1.5, 9 9 2"
SMALL_BIGRAPH_DISCONNECTED = "1 1 1, 1 2 2.5, 1 3 1, 2 1 2, 2 3 2, 3 4 1.5, 5 7 3, 4 7 0, 5 6 1"


def numbers(text: str) -> list[tuple[float, ...]]:
    return [tuple(map(float, row.split())) for row in text.split(",")]


def _edges(spark: SparkSession, text: str) -> DataFrame:
    rows = [(int(r[0]), int(r[1]), r[2] if len(r) > 2 else 1.0) for r in numbers(text)]
    return spark.createDataFrame(rows, "src bigint, dst bigint, weight double")


def _names(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(" ".join(text.split()).split(", "))), "id bigint, name string")


def _position(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(numbers(text))], "id bigint, x double, y double")


def _given(name: str, graph: Graph, metadata: bool, **parts) -> Graph | Dataset:
    return Dataset(name=name, graph=graph, **parts) if metadata else graph


def house(spark: SparkSession, metadata: bool = False) -> Graph | Dataset:
    graph = directed2undirected(from_edges(_edges(spark, HOUSE), 5), weighted=False)
    return _given("house", graph, metadata, position=_position(spark, HOUSE_POSITION))


def bow_tie(spark: SparkSession, metadata: bool = False) -> Graph | Dataset:
    graph = directed2undirected(from_edges(_edges(spark, BOW_TIE), 5), weighted=False)
    return _given("bow_tie", graph, metadata, position=_position(spark, BOW_TIE_POSITION))


def karate_club(spark: SparkSession, metadata: bool = False) -> Graph | Dataset:
    graph = directed2undirected(from_edges(_edges(spark, KARATE_CLUB), 34), weighted=False)
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(KARATE_CLUB_LABELS.split())], "id bigint, label bigint")
    return _given("karate_club", graph, metadata, labels=labels)


def miserables(spark: SparkSession, path: str, metadata: bool = False) -> Graph | Dataset:
    """The undirected, weighted graph of characters that appear together, from a tab-separated file of one pair of names a line."""
    graph, names, _ = tables.from_named_edges(spark.read.csv(path, sep="\t").toDF("src", "dst", *["weight"][: len(spark.read.csv(path, sep="\t").columns) - 2]))
    return _given("miserables", directed2undirected(graph), metadata, names=names)


def painters(spark: SparkSession, metadata: bool = False) -> Graph | Dataset:
    graph = from_edges(_edges(spark, PAINTERS), 14)
    return _given("painters", graph, metadata, names=_names(spark, PAINTERS_NAMES), position=_position(spark, PAINTERS_POSITION))


def hourglass(spark: SparkSession, metadata: bool = False) -> Graph | Dataset:
    return _given("hourglass", from_biadjacency(_edges(spark, HOURGLASS), 2, 2), metadata)


def star_wars(spark: SparkSession, metadata: bool = False) -> Graph | Dataset:
    rows, cols = _names(spark, STAR_WARS_ROWS), _names(spark, STAR_WARS_COLS)
    return _given("star_wars", from_biadjacency(_edges(spark, STAR_WARS), 4, 3), metadata, names=rows, names_row=rows, names_col=cols)


def movie_actor(spark: SparkSession, metadata: bool = False) -> Graph | Dataset:
    rows, cols = _names(spark, MOVIE_ACTOR_ROWS), _names(spark, MOVIE_ACTOR_COLS)
    return _given("movie_actor", from_biadjacency(_edges(spark, MOVIE_ACTOR), 15, 17), metadata, names=rows, names_row=rows, names_col=cols)


def art_philo_science(spark: SparkSession, links: str, words: str | None = None, metadata: bool = False) -> Graph | Dataset:
    """The directed graph of pages that link to each other, from a tab-separated file of one pair of titles a line; with words, a file
    of title, word and count, the dataset also holds the biadjacency of pages and words."""
    graph, names, _ = tables.from_named_edges(spark.read.csv(links, sep="\t").toDF("src", "dst"))
    parts = {"names": names}
    if words:
        counts = spark.read.csv(words, sep="\t").toDF("src", "dst", "weight")
        rows = counts.join(names.withColumnRenamed("name", "src"), "src")
        terms = tables.numbered(counts.select(F.col("dst").alias("name")).distinct())
        told = rows.join(terms.select(F.col("name").alias("dst"), F.col("id").alias("col")), "dst")
        parts |= {"biadjacency": from_biadjacency(told.select(F.col("id").alias("src"), F.col("col").alias("dst"), "weight"), graph.n_row, terms.count()), "names_col": terms}
    return _given("art_philo_science", graph, metadata, **parts)


def small_digraph(spark: SparkSession) -> Graph:
    """Ten nodes, a self-loop at the last."""
    return from_edges(_edges(spark, SMALL_DIGRAPH), 10)


def small_graph(spark: SparkSession) -> Graph:
    return directed2undirected(small_digraph(spark))


def small_bigraph(spark: SparkSession) -> Graph:
    return from_biadjacency(_edges(spark, SMALL_BIGRAPH), 6, 8)


def small_disconnected_graph(spark: SparkSession) -> Graph:
    """Node 0 is isolated."""
    return directed2undirected(from_edges(_edges(spark, SMALL_DISCONNECTED), 10))


def small_disconnected_bigraph(spark: SparkSession) -> Graph:
    """One stored edge has weight zero."""
    return from_biadjacency(_edges(spark, SMALL_BIGRAPH_DISCONNECTED), 6, 8)


def small_graph_bool(spark: SparkSession) -> Graph:
    return directed2undirected(small_digraph(spark), weighted=False)


def clique(spark: SparkSession, n: int = 10) -> Graph:
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst"), F.lit(1.0).alias("weight"))
    return from_edges(pairs.where("src != dst"), n)


def empty_graph(spark: SparkSession, n: int = 10) -> Graph:
    return from_edges(spark.createDataFrame([], "src bigint, dst bigint, weight double"), n)
