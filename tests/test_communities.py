"""Communities, hierarchies, embeddings and neighbours on toy graphs."""

import numpy as np
import pytest

from latticework import api
from latticework.operators import agglomeration, communities, embeddings, hierarchy, learning, linalg, neighbors
from latticework.operators.loops import settled
from latticework.sources import toy


@pytest.fixture(scope="module")
def karate(spark):
    graph = toy.karate_club(spark)
    return type(graph)(settled(graph.edges), 34, 34)


def test_louvain(spark, karate):
    for find in (communities.louvain, communities.leiden):
        labels = settled(find(karate))
        assert labels.select("label").distinct().count() == 4
        assert round(learning.modularity(karate, labels).first()["modularity"], 2) == 0.42
    assert communities.louvain(toy.star_wars(spark)).count() == 7
    with pytest.raises(ValueError):
        communities.louvain(karate, modularity="toto")


def test_rounds_over_strips(karate, monkeypatch):
    def joined(*_):
        raise AssertionError("a round joined the edges with the labels")

    monkeypatch.setattr(communities, "_rounds", joined)
    for find in (communities.louvain, communities.leiden):
        labels = settled(find(karate, most=20))
        assert labels.count() == 34 and learning.modularity(karate, labels).first()["modularity"] > 0.38


def test_louvain_in_rounds(karate):
    labels = settled(communities.louvain(karate, most=20))
    assert labels.count() == 34 and learning.modularity(karate, labels).first()["modularity"] > 0.38


def test_paris(spark, karate):
    house = toy.house(spark)
    tree = settled(agglomeration.paris(house))
    assert [round(r["height"], 2) for r in tree.orderBy("step").collect()] == [0.33, 0.5, 0.62, 1.33]
    assert round(hierarchy.dasgupta_cost(house, tree), 2) == 3.33 and round(hierarchy.tree_sampling_divergence(house, tree), 2) == 0.05
    club = settled(agglomeration.paris(karate))
    for many in (2, 5):
        assert hierarchy.cut_straight(club, 34, n_clusters=many).select("label").distinct().count() == many
    in_rounds = settled(agglomeration.paris(house, most=2))
    assert sorted(round(r["height"], 2) for r in in_rounds.collect()) == [0.33, 0.5, 0.62, 1.33]
    apart = agglomeration.paris(toy.small_disconnected_graph(spark))
    assert apart.where("height = double('infinity')").count() == 3 and apart.count() == 9


@pytest.mark.xfail(reason="gives 6 clusters where the golden value is 7; open", strict=False)
def test_paris_threshold(karate):
    assert hierarchy.cut_straight(settled(agglomeration.paris(karate)), 34, threshold=0.5).select("label").distinct().count() == 7


def test_louvain_hierarchies(spark):
    graph = toy.small_graph(spark)
    graph = type(graph)(settled(graph.edges), 10, 10)
    for build in (agglomeration.louvain_iteration, agglomeration.louvain_hierarchy):
        tree = settled(build(graph))
        assert tree.count() == 9 and tree.agg({"size": "max"}).first()[0] == 10
        assert hierarchy.dasgupta_score(graph, tree) > 0.5
    assert abs(hierarchy.dasgupta_score(graph, settled(agglomeration.paris(graph))) - 0.573) < 0.001
    rows, cols = agglomeration.split_dendrogram(agglomeration.paris(toy.star_wars(spark)), 4, 3)
    assert rows.count() == 3 and cols.count() == 2
    assert agglomeration.get_dendrogram(spark, [[0, 1], [2, [3, 4]]]).count() == 4


def test_singular_values(spark):
    graph = toy.movie_actor(spark)
    dense = linalg.matrix(graph).dense()
    assert np.allclose(embeddings.svd(graph, 3).singular_values, np.linalg.svd(dense)[1][:3])
    assert np.allclose(embeddings.pca(graph, 2).singular_values, np.linalg.svd(dense - dense.mean(axis=0))[1][:2])
    found = embeddings.gsvd(graph, 2)
    assert np.allclose([list(r)[1:] for r in found.predict(graph.edges).orderBy("id").collect()], [list(r)[1:] for r in found.embedding_row.orderBy("id").collect()])


def test_singular_values_in_rounds(spark, monkeypatch):
    graph = toy.star_wars(spark)
    graph = type(graph)(settled(graph.edges), 4, 3, True)
    want = np.linalg.svd(linalg.matrix(graph).dense())[1][:1]
    monkeypatch.setattr(linalg, "DENSE", 0)
    assert np.allclose(linalg.SVDSolver(n_iter=5).fit(linalg.matrix(graph), 1).singular_values_, want)


def test_lazy_matrices(spark):
    graph = toy.small_bigraph(spark)
    a = linalg.matrix(graph)
    dense = a.dense()
    lr = linalg.regularizer(graph, 2)
    want = dense + 2 / 8
    block = linalg.random_block(spark, 8, 2)
    x = np.array([list(r)[1:] for r in block.orderBy("id").collect()])
    told = lambda b: np.array([list(r)[1:] for r in b.orderBy("id").collect()])
    assert np.allclose(told(lr.dot(block)), want @ x) and np.allclose((lr - a).dense(), want - dense) and np.allclose((-lr * 2).T.dense(), -2 * want.T)
    assert abs(lr.sum() - want.sum()) < 1e-9 and np.allclose(told(linalg.normalizer(graph, 1).dot(block)), (dense + 1 / 8) / (dense + 1 / 8).sum(axis=1, keepdims=True) @ x)
    square = toy.small_graph(spark)
    lap = linalg.laplacian_operator(square, 0.5, True)[0].dense()
    reg = linalg.regularizer(square, 0.5).dense()
    d = reg.sum(axis=1)
    assert np.allclose(lap, np.eye(10) - reg / np.sqrt(np.outer(d, d)))
    c = linalg.co_neighbors(graph).dense()
    f = np.where(dense.sum(axis=0) > 0, 1 / np.maximum(dense.sum(axis=0), 1e-9), 0)
    assert np.allclose(c, dense * f @ dense.T)
    y = linalg.random_block(spark, 10, 1)
    m = linalg.matrix(square)
    v = told(y)
    assert np.allclose(told(linalg.Polynome(m, [1, 2, 3]).dot(y)), v + 2 * m.dense() @ v + 3 * m.dense() @ m.dense() @ v)


def test_spectral(spark, karate):
    a = linalg.matrix(karate).dense()
    d = a.sum(axis=1)
    walk = np.sort(np.linalg.eigvalsh(a / np.sqrt(np.outer(d, d))))[::-1]
    assert np.allclose(embeddings.spectral(karate, 2).eigenvalues, walk[1:3])
    plain = np.sort(np.linalg.eigvalsh(np.diag(d) - a))
    assert np.allclose(embeddings.spectral(karate, 2, decomposition="laplacian").eigenvalues, plain[1:3])
    assert embeddings.random_projection(karate).count() == 34
    assert embeddings.louvain_embedding(karate).agg({"prob": "max"}).first()[0] <= 1


def test_neighbors(spark, karate):
    truth = {i: int(x) for i, x in enumerate(toy.KARATE_CLUB_LABELS.split())}
    seeds = spark.createDataFrame([(0, truth[0]), (33, truth[33]), (1, truth[1]), (32, truth[32])], "id bigint, label int")
    labels, probs = neighbors.nn_classifier(karate, seeds, 3)
    told = dict(map(tuple, labels.collect()))
    assert sum(told[i] == truth[i] for i in told if told[i] >= 0) > 20 and probs.groupBy("id").agg({"prob": "sum"}).agg({"sum(prob)": "max"}).first()[0] <= 1 + 1e-9
    links = neighbors.nn_linker(karate, 2, index=[0, 5])
    assert {(r["src"], r["dst"]) for r in links.collect()} >= {(0, 0), (5, 5)} and links.count() == 4


def test_classes(spark, karate):
    rank = api.PageRank()
    assert rank.fit_predict(karate).count() == 34 and rank.get_params()["damping_factor"] == 0.85 and "PageRank(" in repr(rank)
    rank.set_params({"n_iter": 2})
    assert rank.n_iter == 2
    with pytest.raises(ValueError):
        rank.set_params({"toto": 1})
    with pytest.raises(ValueError):
        api.PageRank(damping_factor=2)
    both = api.Louvain().fit(toy.star_wars(spark))
    assert both.labels_row_.count() == 4 and both.labels_col_.count() == 3 and both.predict_proba().count() > 0 and both.aggregate_.count() > 0
    heat = api.Dirichlet().fit(toy.house(spark), {0: 1, 2: 0})
    assert [round(r["value"], 2) for r in heat.predict().orderBy("id").collect()] == [1, 0.54, 0, 0.31, 0.62]
    seeds = {0: 1, 33: 0}
    truth = [int(x) for x in toy.KARATE_CLUB_LABELS.split()]
    told = [r["label"] for r in api.DiffusionClassifier().fit_predict(karate, seeds).orderBy("id").collect()]
    assert sum(a == b for a, b in zip(told, truth)) / 34 >= 0.97
