"""Golden values and definitions for the graph operators."""

import glob
import os

import duckdb
import pytest

from latticework.graph import degrees, directed2undirected, from_list, is_symmetric
from latticework.operators import learning, ranking, topology
from latticework.plans import queries as registry

HOUSE = [(0, 1), (0, 4), (1, 2), (1, 4), (2, 3), (3, 4)]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def house(spark):
    return directed2undirected(from_list(spark, HOUSE))


def values(df, name):
    return [round(r[name], 2) for r in df.orderBy("id").collect()]


def test_house(spark, house):
    seeds = spark.createDataFrame([(0, 1.0), (2, 0.0)], "id bigint, value double")
    assert is_symmetric(house) and values(degrees(house), "degree") == [2, 3, 2, 2, 3]
    one = spark.createDataFrame([(0, 1.0)], "id bigint, value double")
    assert values(ranking.pagerank(house, seeds=one), "score") == [0.29, 0.24, 0.12, 0.12, 0.24]
    assert [round(x, 2) for x in (6.5, 8.25, 5.62, 5.62, 8.25)] == values(ranking.katz(house), "score")
    assert values(learning.diffusion(house, seeds, n_iter=1), "value") == [0.75, 0.5, 0.25, 0.38, 0.58]
    assert values(learning.dirichlet(house, seeds), "value") == [1.0, 0.54, 0.0, 0.31, 0.62]
    labels = spark.createDataFrame(list(enumerate([0, 0, 1, 1, 0])), "id bigint, label bigint")
    assert round(learning.modularity(house, labels).first()["modularity"], 2) == 0.11


def test_clique(spark):
    clique = directed2undirected(from_list(spark, [(i, j) for i in range(10) for j in range(i)]))
    assert topology.count_triangles(clique).first()["n"] == 120
    assert {r["core"] for r in topology.core_decomposition(clique).collect()} == {9}


def test_labels(spark):
    labels = spark.createDataFrame(list(enumerate([0, 0, 1, 2, 2, 2])), "id bigint, label bigint")
    assert values(learning.reindex_labels(labels), "label") == [1, 1, 2, 0, 0, 0]
    pairs = spark.createDataFrame(list(zip([0, 1, 1, 2, 2, -1], [0, -1, 1, 2, 0, 0])), "label_true int, label_pred int")
    f1 = {r["label"]: r["f1"] for r in learning.f1_scores(pairs).collect()}
    assert round(sum(f1.values()) / 3, 2) == 0.78


def test_distances(spark):
    path = from_list(spark, [(0, 1), (1, 2), (3, 2)], 5)
    assert values(topology.distances(path, [0]), "distance") == [0, 1, 2, -1, -1]
    assert topology.shortest_path_dag(path, [0]).count() == 2
    assert values(topology.connected_components(path), "component") == [0, 0, 0, 0, 4]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_definition(spark, name):
    base = duckdb.connect()
    base.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        base.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = base.sql(f"select {', '.join(names)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want)
