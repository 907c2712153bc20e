"""Paths, parts, cycles, networks, images and streams on small graphs."""

import numpy as np
import pytest

from latticework.graph import from_list
from latticework.operators import cycles, layouts, paths
from latticework.operators.gnn import GNNClassifier, get_activation, get_layer, get_loss
from latticework.sources import models, toy
from latticework.visualization import svg_dendrogram, svg_graph, visualize_bigraph
from latticework.visualization.drawing import leaf_order, svg_pie_chart_node


def column(df, name="distance"):
    return [r[name] for r in df.orderBy("id").collect()]


def test_distances(spark):
    assert column(paths.get_distances(toy.small_graph(spark), 0)) == [0, 1, 3, 2, 2, 3, 2, 3, 4, 4]
    rows, cols = paths.get_distances(toy.small_bigraph(spark), source=0)
    assert column(rows) == [0, -1, 2, -1, -1, -1] and column(cols)[:2] == [3, 1]
    with pytest.raises(ValueError):
        paths.get_distances(toy.small_graph(spark))
    with pytest.raises(ValueError):
        paths.get_distances(toy.small_bigraph(spark), source=0, source_row=1)
    assert [r["id"] for r in paths.breadth_first_search(toy.small_graph(spark), 3).collect()][:2] == [3, 1]
    assert paths.get_shortest_path(toy.small_digraph(spark), 0).edges.count() == 5 and paths.get_shortest_path(toy.small_bigraph(spark), 0).edges.count() == 3
    order = spark.createDataFrame([(i, i % 3) for i in range(10)], "id bigint, value int")
    assert [paths.get_dag(toy.small_graph(spark), order=o).edges.count() for o in (None, order)] == [12, 10]


def test_parts(spark):
    assert sorted(set(column(paths.get_connected_components(toy.small_disconnected_graph(spark)), "label"))) == [0, 1, 2, 3]
    part, rows, cols = paths.get_largest_connected_component(toy.small_disconnected_bigraph(spark))
    assert part.bipartite and part.n_row == rows.count() and part.n_col == cols.count()
    even, odd = models.cyclic_graph(spark, 4), models.cyclic_graph(spark, 3)
    told, rows, cols = paths.split_bipartite(even)
    assert (told.n_row, told.n_col) == (2, 2) and [r["old"] for r in rows.orderBy("id").collect()] == [0, 2] and paths.split_bipartite(odd) is None
    assert paths.is_acyclic(models.linear_graph(spark, 3)) and not paths.is_acyclic(odd) and not paths.is_acyclic(models.cyclic_digraph(spark, 3))


def test_cycles(spark):
    graph = from_list(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (1, 3)])
    assert sorted(cycles.get_cycles(graph, directed=True)) == [[0, 1, 2, 3], [0, 1, 3]]
    assert cycles.get_cycles(models.star(spark, 3)) == [] and [sorted(c) for c in cycles.get_cycles(models.cyclic_graph(spark, 4))] == [[0, 1, 2, 3]]
    for directed, cycle in ((True, models.cyclic_digraph(spark, 4)), (False, models.cyclic_graph(spark, 4)), (True, graph)):
        assert paths.is_acyclic(cycles.break_cycles(cycle, 0, directed), directed)
    assert cycles.are_isomorphic(toy.house(spark), toy.house(spark)) and not cycles.are_isomorphic(toy.house(spark), toy.bow_tie(spark))


def test_network(spark):
    graph = toy.karate_club(spark, True)
    seeds = graph.labels.where("id in (0, 1, 2, 33, 32, 31, 8, 30)")
    net = GNNClassifier([8, 2], early_stopping=False).fit(graph.graph, np.eye(34), seeds, n_epochs=60, random_state=42)
    told, truth = column(net.predict(), "label"), column(graph.labels, "label")
    assert net.history["loss"][-1] < net.history["loss"][0] and sum(a == b for a, b in zip(told, truth)) / 34 > 0.8
    features = spark.createDataFrame([(i, *[float(i == j) for j in range(34)]) for i in range(34)], "id bigint, " + ", ".join(f"v{j} double" for j in range(34)))
    assert column(net.predict_large(graph.graph, features), "label") == told
    assert net.predict_proba().count() == 34 and GNNClassifier([4, 1], layer_types="sage", loss="BCE").fit(graph.graph, np.eye(34), seeds, n_epochs=3, random_state=1).predict().count() == 34
    with pytest.raises(ValueError):
        get_layer("toto", out_channels=2)
    with pytest.raises(ValueError):
        get_activation("toto")


def test_gradients():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 3)), np.array([0, 2, 1, 1, 0])
    for name in ("CrossEntropy", "BCE"):
        loss, step = get_loss(name), 1e-6
        told = loss.loss_gradient(x, y)
        for i, j in ((0, 0), (3, 1)):
            z = x.copy()
            z[i, j] += step
            assert abs((loss.loss(z, y) - loss.loss(x, y)) / step - told[i, j]) < 1e-4
    for name in ("relu", "sigmoid", "softmax"):
        act, way = get_activation(name), rng.normal(size=(5, 3))
        z = x.copy()
        z[1, 2] += 1e-6
        assert abs((((act.output(z) - act.output(x)) * way).sum() / 1e-6) - act.gradient(x, way)[1, 2]) < 1e-4
    p = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert get_loss("CrossEntropy").loss(100 * p, np.array([0, 1])) < 1e-6


def test_images(spark, tmp_path):
    house = toy.house(spark, True)
    told = svg_graph(house.graph, house.position.selectExpr("id", "x as v0", "y as v1"), names=list("abcde"), labels={0: 1}, filename=str(tmp_path / "house"))
    assert told.startswith("<svg") and told.count("<circle") == 5 and told.count("<path") == 6 and (tmp_path / "house.svg").exists()
    assert "marker-end" in svg_graph(models.cyclic_digraph(spark, 3), scores=[1, 2, 3])
    assert visualize_bigraph(toy.star_wars(spark), names_row=list("abcd"), reorder=False).count("<circle") == 7
    tree = spark.createDataFrame([(0, 0, 1, 1.0, 2), (1, 2, 3, 2.0, 3)], "step bigint, left bigint, right bigint, height double, size bigint")
    assert svg_dendrogram(tree, names=["a", "b", "c"]).count("<path") == 6 and svg_dendrogram(tree, rotate=True).startswith("<svg")
    assert leaf_order([(0, 1, 1.0, 2), (2, 3, 2.0, 3)]) == [2, 0, 1] and svg_pie_chart_node((0, 0), 5, [0.5, 0.5], ["red", "blue"]).count("<path") == 2
    assert layouts.spring(house.graph, n_iter=5).count() == layouts.force_atlas(house.graph, n_iter=5).count() == 5


def test_stream(spark, tmp_path):
    from latticework.streaming import merge_degrees, stream_degrees

    spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0)], "src bigint, dst bigint, weight double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src bigint, dst bigint, weight double").parquet(str(tmp_path / "in"))
    stream_degrees(stream, str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination(120)
    assert {(r["id"], r["side"]): r["weight"] for r in merge_degrees(spark, str(tmp_path / "state")).collect()}[(0, "out")] == 3.0
