"""Generated graphs, named edge lists and the operators that need directed or regular graphs."""

from latticework.graph import directed2undirected, from_list
from latticework.operators import topology
from latticework.sources import models, tables


def pairs(graph):
    return sorted((r["src"], r["dst"]) for r in graph.edges.collect())


def test_models(spark):
    assert pairs(models.linear_digraph(spark, 4)) == [(0, 1), (1, 2), (2, 3)]
    assert pairs(models.cyclic_digraph(spark, 3)) == [(0, 1), (1, 2), (2, 0)]
    assert len(pairs(models.star(spark, 5))) == 10 and models.star(spark, 5).n == 6
    assert len(pairs(models.grid(spark, 3, 4))) == 2 * (3 * 3 + 2 * 4)


def test_cycles(spark):
    assert topology.is_acyclic(models.linear_digraph(spark, 4)) and not topology.is_acyclic(models.cyclic_digraph(spark, 4))
    assert topology.is_bipartite(models.cyclic_graph(spark, 4)) and not topology.is_bipartite(models.cyclic_graph(spark, 5))


def test_strong_components(spark):
    graph = from_list(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0)], 7)
    found = {r["id"]: r["component"] for r in topology.strong_components(graph).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    assert sorted(r["id"] for r in topology.largest_component(graph, strong=True).collect()) == [0, 1, 2]


def test_color_refinement(spark):
    house = directed2undirected(from_list(spark, [(0, 1), (0, 4), (1, 2), (1, 4), (2, 3), (3, 4)]))
    found = {r["id"]: r["color"] for r in topology.color_refinement(house).collect()}
    assert found == {0: 0, 1: 1, 4: 1, 2: 2, 3: 2}


def test_named_edges(spark, tmp_path):
    (tmp_path / "e.csv").write_text("# edges\nbob,amy,2\namy,cid,1\nbob,amy,3\n")
    graph, rows, _ = tables.from_csv(spark, str(tmp_path / "e.csv"))
    assert {r["name"]: r["id"] for r in rows.collect()} == {"amy": 0, "bob": 1, "cid": 2}
    assert sorted(tuple(r) for r in graph.edges.select("src", "dst", "weight").collect()) == [(0, 2, 1.0), (1, 0, 5.0)]
    tables.save(graph, str(tmp_path / "g"))
    assert pairs(tables.load(spark, str(tmp_path / "g"))) == [(0, 2), (1, 0)]
    lists = spark.createDataFrame([("x", ["p", "q"]), ("y", ["q"])], "node string, neighbors array<string>")
    graph, rows, cols = tables.from_adjacency_list(lists, bipartite=True)
    assert (graph.n_row, graph.n_col, pairs(graph)) == (2, 2, [(0, 0), (0, 1), (1, 1)])
