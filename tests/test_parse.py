"""Parsers and datasets on small files."""

import pytest

from latticework.operators import metrics, values
from latticework.sources import dataset, parse, toy

GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<desc>Some file</desc><key id="d0" for="edge" attr.name="weight" attr.type="int"/>
<key id="d1" for="node" attr.name="color" attr.type="string"><desc>Color</desc><default>blue</default></key>
<key id="d2" for="edge" attr.name="distance" attr.type="double"><desc>Distance</desc><default>1.5</default></key>
<graph edgedefault="undirected" parse.nodeids="canonical" parse.nodes="3">
<node id="n0"><data key="d1">green</data></node><node id="n1"/><node id="n2"/>
<edge source="n0" target="n1"><data key="d0">1</data><data key="d2">7.2</data></edge>
<edge source="n1" target="n2" directed='true'><data key="d0">1</data></edge>
<edge source="n0" target="n2" directed='false'><data key="d0">1</data></edge></graph></graphml>"""


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def put(tmp_path):
    def write(text):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}"
        path.write_text(text)
        return str(path)

    return write


def test_csv(spark, put):
    numbers = put("%stub\n1 3\n4 5\n0 2")
    assert parse.scan_header(spark, numbers) == (1, " ", "%", "edge_list")
    told = parse.from_csv(spark, numbers)
    assert told.graph.n_row == 6 and rows(told.graph.edges)[0] == (0, 2, 1.0) and "names" not in told
    assert parse.from_csv(spark, numbers, shape=(7, 7)).graph.n_row == 7
    names = parse.from_csv(spark, put("%stub\nf, e, 5\na, d, 6\nc, b, 1"))
    assert [n for _, n in rows(names.names)] == [" b", " d", " e", "a", "c", "f"] and rows(names.graph.edges)[0] == (0, 4, 1.0)
    assert [int(n) for _, n in rows(parse.from_csv(spark, put("14 31\n42 50\n0 12"), reindex=True).names)] == [0, 12, 14, 31, 42, 50]
    with pytest.raises(ValueError):
        parse.from_csv(spark, put("1 3 a\n4 5 b\n0 2 e"))
    both = put("1\t3\n4\t5\n0\t3")
    for reindex, size in ((True, (3, 2)), (False, (5, 6))):
        graph = parse.from_csv(spark, both, bipartite=True, reindex=reindex).graph
        assert (graph.n_row, graph.n_col) == size
    lists = parse.from_csv(spark, put("2 3\n3 0 1\n5\n4\n5"), data_structure="adjacency_list", delimiter=" ")
    assert lists.graph.n_row == 6 and rows(lists.graph.edges)[:2] == [(0, 1, 1.0), (0, 2, 1.0)]


def test_lists(spark):
    told = parse.from_edge_list(spark, [("a", "b", 2), ("a", "b", 3), ("c", "a", 1)], directed=True)
    assert rows(told.graph.edges) == [(0, 1, 5.0), (2, 0, 1.0)]
    told = parse.from_edge_list(spark, [("a", "b", 2), ("a", "b", 1), ("c", "a", 1)], directed=True, sum_duplicates=False)
    assert rows(told.graph.edges) == [(0, 1, 2.0), (2, 0, 1.0)]
    assert rows(parse.from_edge_list(spark, [(0, 1, 4), (0, 1, 5)], directed=True, weighted=False).graph.edges) == [(0, 1, 1.0)]
    assert rows(parse.from_adjacency_list(spark, {"Alice": ["Bob"], "Bob": ["Alice"]}).graph.edges) == [(0, 1, 2.0), (1, 0, 2.0)]
    with pytest.raises(ValueError):
        parse.from_edge_list(spark, [(0, 1), (0, 1, 2)])


def test_graphml(spark, put):
    told = parse.from_graphml(spark, put(GRAPHML))
    assert rows(told.graph.edges) == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 0, 1.0)]
    assert rows(told.node_attribute) == [(0, "green"), (1, "blue"), (2, "blue")]
    assert [r[2] for r in rows(told.edge_attribute)] == [7.2, 1.5, 7.2, 1.5, 1.5]
    assert told.meta.description == "Some file" and told.meta.attributes.node.color == "Color" and told.meta.attributes.edge.distance == "Distance"
    assert rows(parse.from_graphml(spark, put(GRAPHML.replace('parse.nodeids="canonical"', ""))).names)[0] == (0, "n0")
    with pytest.raises(ValueError):
        parse.from_graphml(spark, put("<graphml></graphml>"))


def test_small_files(spark, put, tmp_path):
    assert rows(parse.load_labels(spark, put("a\n b \nc"))) == [(0, "a"), (1, "b"), (2, "c")]
    assert parse.load_header(spark, put("% asym bip unweighted\n1 2")) == (True, True, False)
    assert dict(parse.load_metadata(spark, put("Name: x: y\nSize: 3"))) == {"Name": "x: y", "Size": "3"}
    assert parse.graphml_type("long") == "double" and parse.graphml_type("other") is None
    folder = str(tmp_path / "home")
    dataset.save_bundle(spark, toy.star_wars(spark, True), "star_wars", folder)
    told = dataset.load_bundle(spark, "star_wars", folder)
    assert told.name == "star_wars" and told.graph.bipartite and rows(told.names_col)[0] == (0, "A New Hope")
    dataset.clean_data_home(spark, folder)
    with pytest.raises(FileNotFoundError):
        dataset.load_bundle(spark, "star_wars", folder)


def test_toy_sizes(spark):
    sizes = [(toy.house, 5, 12), (toy.bow_tie, 5, 12), (toy.karate_club, 34, 156), (toy.painters, 14, 50), (toy.hourglass, 2, 4), (toy.star_wars, 4, 8), (toy.movie_actor, 15, 43)]
    sizes += [(toy.small_digraph, 10, 13), (toy.small_bigraph, 6, 9), (toy.small_disconnected_bigraph, 6, 9), (toy.clique, 10, 90), (toy.empty_graph, 10, 0)]
    assert [(f(spark).n_row, f(spark).edges.count()) for f, _, _ in sizes] == [(n, m) for _, n, m in sizes]


def test_values_and_metrics(spark):
    graph = toy.star_wars(spark)
    assert [v for _, v in rows(values.get_adjacency_values(graph)[1])] == [1.0] * 4 + [-1.0] * 3
    assert [v for _, v in rows(values.get_values(spark, 3, {0: 2}))] == [2.0, -1.0, -1.0]
    with pytest.raises(ValueError):
        values.values2prob(values.get_values(spark, 2, [0, 0]))
    table = lambda x: spark.createDataFrame(list(enumerate(x)), "id bigint, label int")
    true, told = table([0, 1, 1, 2, 2, -1]), table([0, -1, 1, 2, 0, 0])
    assert [round(metrics.average_f1(true, told, a), 2) for a in ("macro", "micro", "weighted")] == [0.78, 0.75, 0.8]
    assert metrics.accuracy(true, told) == 0.75 and metrics.f1_score(table([0, 1, 1]), table([0, 1, 0]))[1:] == (1.0, 0.5)


def test_weighted_f1_counts_labels_never_predicted(spark):
    table = lambda x: spark.createDataFrame(list(enumerate(x)), "id bigint, label int")
    assert metrics.average_f1(table([0, 0, 1, 2, 2]), table([0, 0, 1, -1, -1]), "weighted") == 0.6
    assert metrics.average_f1(table([0, 1]), table([-1, -1]), "weighted") is None
