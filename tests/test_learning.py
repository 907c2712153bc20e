"""Golden values and brute-force versions for centralities, classifiers and dendrograms."""

from itertools import combinations

import numpy as np
import pytest

from latticework.graph import directed2undirected, from_list
from latticework.operators import centrality, classifiers, hierarchy, ranking, spread, topology
from latticework.sources import models

HOUSE = [(0, 1), (0, 4), (1, 2), (1, 4), (2, 3), (3, 4)]
BOW_TIE = [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4), (3, 4)]
PARIS_HOUSE = [(0, 3, 2, 0.17, 2), (1, 1, 0, 0.25, 2), (2, 6, 4, 0.31, 3), (3, 7, 5, 0.67, 5)]
TREE = "step bigint, left bigint, right bigint, height double, size bigint"


@pytest.fixture(scope="module")
def house(spark):
    return directed2undirected(from_list(spark, HOUSE))


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = np.random.default_rng(3)
    return from_list(spark, [(i, j) for i in range(14) for j in range(14) if i != j and rng.random() < 0.2], 15)


def dense(graph):
    a = np.zeros((graph.n, graph.n))
    for r in graph.edges.collect():
        a[r["src"], r["dst"]] += r["weight"]
    return a


def by_id(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_closeness(spark, random_graph):
    assert [round(s, 2) for s in by_id(centrality.closeness(models.cyclic_digraph(spark, 3)), "score")] == [0.67] * 3
    assert set(by_id(centrality.closeness(random_graph), "score")) == {0.0}  # node 14 is isolated


def test_betweenness(spark, random_graph):
    assert by_id(centrality.betweenness(directed2undirected(from_list(spark, BOW_TIE))), "score") == [4, 0, 0, 0, 0]
    a = dense(random_graph) > 0
    n = len(a)
    walks, d, paths = np.eye(n), np.where(np.eye(n) > 0, 0, -1), np.eye(n)
    for k in range(1, n):
        walks = walks @ a
        fresh = (d < 0) & (walks > 0)
        d[fresh], paths[fresh] = k, walks[fresh]
    want = [sum(paths[s, v] * paths[v, t] / paths[s, t] for s in range(n) for t in range(n) if v not in (s, t) and s != t and min(d[s, v], d[v, t]) > 0 and d[s, v] + d[v, t] == d[s, t]) / 2 for v in range(n)]
    assert np.allclose(by_id(centrality.betweenness(random_graph), "score"), want)


@pytest.fixture(scope="module")
def wide_graph(spark):
    """150 nodes, three words of bits: a cycle, so that all are reached, a hub and random edges, with hops far apart."""
    rng = np.random.default_rng(5)
    pairs = [(i, (i + 1) % 150) for i in range(150)] + [(7, j) for j in range(20, 60)] + [(int(a), int(b)) for a, b in rng.integers(0, 150, (60, 2))]
    return from_list(spark, [(a, b) for a, b in dict.fromkeys(pairs) if a != b])


def hops_and_paths(graph):
    a = dense(graph) > 0
    n = len(a)
    walks, hops, paths = np.eye(n), np.where(np.eye(n) > 0, 0, -1), np.eye(n)
    for k in range(1, n):
        walks = np.where((hops == k - 1), walks, 0) @ a
        fresh = (hops < 0) & (walks > 0)
        hops[fresh], paths[fresh] = k, walks[fresh]
    return hops, paths


def no_pairs(*_):
    raise AssertionError("a table of pairs was written")


def test_closeness_without_a_table_of_pairs(wide_graph, monkeypatch):
    hops, _ = hops_and_paths(wide_graph)
    assert (hops >= 0).all() and hops.max() > 5
    monkeypatch.setattr(centrality, "settled", no_pairs)
    assert np.allclose(by_id(centrality.closeness(wide_graph), "score"), 149 / hops.sum(axis=1))
    some = wide_graph.nodes.where("id in (3, 140)")
    assert np.allclose(by_id(centrality.closeness(wide_graph, some), "score"), 149 / hops.sum(axis=1)[[3, 140]])

def test_betweenness_without_a_table_of_pairs(wide_graph, monkeypatch):
    hops, paths = hops_and_paths(wide_graph)
    monkeypatch.setattr(centrality, "settled", no_pairs)
    want = np.zeros(150)
    for v in range(150):
        on = (hops[:, [v]] + hops[[v]] == hops) & (hops > 0)
        on[v], on[:, v] = False, False
        want[v] = (np.where(on, paths[:, [v]] * paths[[v]] / np.maximum(paths, 1), 0)).sum() / 2
    assert np.allclose(by_id(centrality.betweenness(wide_graph), "score"), want)


def test_cliques(spark, random_graph):
    clique = directed2undirected(from_list(spark, [(i, j) for i in range(7) for j in range(i)]))
    assert topology.count_cliques(clique, 4).first()["n"] == 35
    a = dense(random_graph)
    a = (a + a.T) > 0
    for k in (3, 4):
        want = sum(all(a[i, j] for i, j in combinations(c, 2)) for c in combinations(range(15), k))
        assert topology.count_cliques(random_graph, k).first()["n"] == want
    assert topology.is_connected(clique) and not topology.is_connected(random_graph)


def joins(df):
    """The joins of a plan by a key; those with a few broadcast rows aside."""
    plan = df._jdf.queryExecution().toString()
    return [k for k in ("SortMergeJoin", "HashJoin") if k in plan]


@pytest.fixture(scope="module")
def dense_graph(spark):
    rng = np.random.default_rng(8)
    return from_list(spark, [(i, j) for i in range(40) for j in range(40) if i != j and rng.random() < (0.6 if i < 8 else 0.15)], 42)


def cliques_by_brute_force(graph, k):
    a = dense(graph)
    a = (a + a.T) > 0
    return sum(all(a[i, j] for i, j in combinations(c, 2)) for c in combinations(range(graph.n), k))


def test_triangles_are_closed_in_blocks(dense_graph, monkeypatch):
    told = topology.count_triangles(dense_graph)
    assert told.first()["n"] == cliques_by_brute_force(dense_graph, 3) and not joins(told)  # no table of wedges is joined
    monkeypatch.setattr(spread, "STEP", 5)
    assert topology.count_triangles(dense_graph).first()["n"] == told.first()["n"]
    assert topology.count_triangles(from_list(dense_graph.edges.sparkSession, [(0, 0)], 3)).first()["n"] == 0


def test_clustering_coefficient_joins_no_wedges(dense_graph):
    told = topology.clustering_coefficient(dense_graph)
    a = dense(dense_graph)
    d = ((a + a.T) > 0).sum(axis=1)
    assert np.isclose(told.first()["coefficient"], 3 * cliques_by_brute_force(dense_graph, 3) / (d * (d - 1) / 2).sum()) and not joins(told)


def test_cliques_are_counted_where_their_first_node_is(dense_graph):
    for k in (2, 4, 5):
        told = topology.count_cliques(dense_graph, k)
        assert told.first()["n"] == cliques_by_brute_force(dense_graph, k) and not joins(told)


def no_join(*_):
    raise AssertionError("the edges were joined with the vector")


def test_pagerank_rounds_move_no_edges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b), int(w)) for a, b, w in rng.integers(1, 30, (200, 3))]
    twice = from_list(spark, [(a + 30 * k, b + 30 * k, w) for a, b, w in dict(((a, b), (a, b, w)) for a, b, w in pairs).values() for k in (0, 1)], 60)
    monkeypatch.setattr(ranking, "spmv", no_join)
    told = np.array(by_id(ranking.pagerank(twice, tol=0), "score"))
    assert (told[:30] == told[30:]).all()  # equal nodes tie exactly, so their order is that of their ids
    a = dense(twice)
    out = a.sum(axis=1)
    b = (1 - 0.85 * (out > 0)) / 60
    x = b
    for _ in range(10):
        x = 0.85 * (x / np.where(out > 0, out, 1)) @ a + b * x.sum()
    assert np.allclose(told, x / x.sum())
    seeds = spark.createDataFrame([(2, 1.0), (33, -4.0)], "id bigint, value double")
    assert (np.array(by_id(ranking.pagerank(twice, seeds=seeds), "score"))[30:] == 0).all()


def test_katz_rounds_move_no_edges(random_graph, monkeypatch):
    monkeypatch.setattr(ranking, "spmv", no_join)
    a = (dense(random_graph) != 0).astype(float)
    want = sum(0.5**k * np.linalg.matrix_power(a.T, k) @ np.ones(15) for k in (1, 2, 3, 4))
    assert np.allclose(by_id(ranking.katz(random_graph), "score"), want)


def test_core_rounds_move_no_edges(dense_graph, monkeypatch):
    monkeypatch.setattr(topology, "Window", None)  # that of the rounds that shuffle
    both = directed2undirected(dense_graph, weighted=False)
    a, want = dense(both) > 0, np.zeros(42, int)
    for k in range(1, 42):
        left = np.ones(42, bool)
        while (new := left & (a[:, left].sum(axis=1) >= k)).sum() < left.sum():
            left = new
        want[left] = k
    assert by_id(topology.core_decomposition(both), "core") == want.tolist() and len(set(want)) > 2


def test_pagerank_classifier(spark, random_graph):
    seeds = {0: 2, 3: 2, 5: 7, 6: 9}
    df = spark.createDataFrame(list(seeds.items()), "id bigint, label bigint")
    found = classifiers.pagerank_classifier(random_graph, df)
    scores = []
    for label in (2, 7, 9):
        one = spark.createDataFrame([(i, 1.0) for i, x in seeds.items() if x == label], "id bigint, value double")
        scores.append(by_id(ranking.pagerank(random_graph, seeds=one), "score"))
    scores = np.array(scores).T
    total = scores.sum(axis=1)
    want = np.where(total > 0, scores.max(axis=1) / np.where(total > 0, total, 1), 0)
    assert by_id(found, "label") == [(2, 7, 9)[i] for i in scores.argmax(axis=1)]
    assert np.allclose(by_id(found, "prob"), want)


def test_diffusion_classifier(spark, random_graph):
    seeds = {0: 2, 3: 2, 5: 7, 6: 9}
    found = classifiers.diffusion_classifier(random_graph, spark.createDataFrame(list(seeds.items()), "id bigint, label bigint"))
    a = dense(random_graph)
    out = a.sum(axis=1, keepdims=True)
    p, t = a / np.where(out > 0, out, 1), np.full((15, 3), 0.5)
    hot = {i: np.eye(3)[(2, 7, 9).index(x)] for i, x in seeds.items()}
    for k in range(11):
        t = p @ t if k else t
        for i, row in hot.items():
            t[i] = row
    t = t - t.mean(axis=0)
    e = np.exp(5 * t)
    reached = np.linalg.matrix_power(np.eye(15) + a, 15)[list(seeds)].sum(axis=0) > 0
    want = np.where(reached, np.array([2, 7, 9])[t.argmax(axis=1)], -1)
    assert by_id(found, "label") == list(want)
    assert np.allclose(by_id(found, "prob"), np.where(reached, e.max(axis=1) / e.sum(axis=1), 0))


def test_propagation(spark, house):
    seeds = spark.createDataFrame([(0, 0), (2, 1)], "id bigint, label bigint")
    assert by_id(classifiers.propagation(house, seeds), "label")[0::2][:2] == [0, 1]
    two = directed2undirected(from_list(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)], 7))
    assert by_id(classifiers.propagation(two, spark.createDataFrame([(0, 5), (3, 4), (6, -1)], "id bigint, label bigint")), "label") == [5, 5, 5, 4, 4, 4, -1]
    found = by_id(classifiers.propagation_clusters(two), "label")
    assert len(set(found[:3]) & set(found[3:6])) == 0 and found[6] == 6


def test_neighbor_sample(spark, house):
    kept = classifiers.sample_neighbors(house, 2).groupBy("src").count().collect()
    assert {r["count"] for r in kept} == {2}


def test_cuts(spark):
    tree = spark.createDataFrame([(0, 0, 1, 0.0, 2), (1, 2, 3, 1.0, 3)], TREE)
    assert by_id(hierarchy.cut_straight(tree, 3), "label") == [0, 0, 1]
    assert by_id(hierarchy.cut_straight(tree, 3, threshold=0.5), "label") == [0, 0, 1]
    house = spark.createDataFrame(PARIS_HOUSE, TREE)
    assert by_id(hierarchy.cut_straight(house, 5), "label") == [0, 0, 1, 1, 0]
    assert by_id(hierarchy.cut_straight(house, 5, n_clusters=3), "label") == [0, 0, 1, 1, 2]
    assert by_id(hierarchy.cut_balanced(house, 5, 2), "label") == [0, 0, 1, 1, 2]
    top = hierarchy.aggregate_dendrogram(house, 5, 3).orderBy("step").collect()
    assert [(r["left"], r["right"]) for r in top] == [(2, 0), (3, 1)]


def test_dendrogram_metrics(spark, house, random_graph):
    assert round(hierarchy.dasgupta_score(house, spark.createDataFrame(PARIS_HOUSE, TREE)), 2) == 0.33
    rng = np.random.default_rng(5)
    left, rows, leaves = list(range(15)), [], {i: [i] for i in range(15)}
    for step in range(14):
        i, j = (left.pop(int(rng.integers(len(left)))) for _ in range(2))
        leaves[15 + step] = leaves[i] + leaves[j]
        rows.append((step, i, j, float(step), len(leaves[15 + step])))
        left.append(15 + step)
    tree = spark.createDataFrame(rows, TREE)
    a = dense(random_graph)
    for weights in ("uniform", "degree"):
        out, into = (np.full(15, 1 / 15),) * 2 if weights == "uniform" else (a.sum(axis=1) / a.sum(), a.sum(axis=0) / a.sum())
        want = 0.0
        for _, i, j, _, _ in rows:
            between = a[np.ix_(leaves[i], leaves[j])].sum() + a[np.ix_(leaves[j], leaves[i])].sum()
            want += between / a.sum() * (out[leaves[i] + leaves[j]].sum() + into[leaves[i] + leaves[j]].sum()) / 2
        assert np.isclose(hierarchy.dasgupta_cost(random_graph, tree, weights, normalized=True), want)
    assert 0 < hierarchy.tree_sampling_divergence(house, spark.createDataFrame(PARIS_HOUSE, TREE)) < 1
