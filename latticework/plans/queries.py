"""Registered graph queries over the driver's tables, each with a DuckDB definition written from the formula."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, bipartite2undirected, degrees, directed2undirected, from_biadjacency, from_edges, weights
from ..functions import scalar
from ..operators import agglomeration, centrality, checks, classifiers, communities, embeddings, learning, linalg, neighbors, paths, ranking, topology, values
from ..sources import models


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return from_biadjacency(rows, _table(spark, sf_dir, "part").count(), _table(spark, sf_dir, "supplier").count())


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Supplier nation -> customer nation, by number of line items."""
    li, o = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    return from_edges(rows.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("weight")), 25)


def sequence(spark: SparkSession, sf_dir: str) -> Graph:
    """User -> user of the next event of the same day, by (ts, event_id), over all events."""
    e = _table(spark, sf_dir, "events")
    nxt = F.lead("user_id").over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").alias("src"), nxt.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    n = e.agg(F.max("user_id")).first()[0] + 1
    return from_edges(rows, n)


PS = "ps AS (SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2), np AS (SELECT count(*) AS n FROM part), ns AS (SELECT count(*) AS n FROM supplier)"
BLOCK = PS + ", e AS (SELECT src, dst + (SELECT n FROM np) AS dst, weight FROM ps UNION ALL SELECT dst + (SELECT n FROM np), src, weight FROM ps), nodes AS (SELECT range AS id FROM range((SELECT n FROM np) + (SELECT n FROM ns)))"
TRADE = "e AS (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
SEQ = "q AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM q WHERE dst IS NOT NULL GROUP BY 1, 2), nodes AS (SELECT range AS id FROM range((SELECT max(user_id) + 1 FROM events)))"
UND = ", u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"


def _rounds(k: int, first: str, step: str) -> str:
    """CTEs x0, x1, ... xk; step is written over {x}."""
    return f", x0 AS MATERIALIZED ({first})" + "".join(f", x{i + 1} AS MATERIALIZED ({step.replace('{x}', f'x{i}')})" for i in range(k))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


_PR = _rounds(
    10,
    "SELECT id, b AS v FROM b",
    "SELECT b.id, 0.85 * coalesce(m.v, 0) + b.b * (SELECT sum(v) FROM {x}) AS v FROM b LEFT JOIN (SELECT p.dst AS id, sum(p.w * x.v) AS v FROM p JOIN {x} x ON x.id = p.src GROUP BY 1) m USING (id)",
)
PAGERANK = f"""WITH {BLOCK}, o AS (SELECT src, sum(weight) AS t FROM e GROUP BY 1), p AS MATERIALIZED (SELECT src, dst, weight / t AS w FROM e JOIN o USING (src)),
b AS MATERIALIZED (SELECT id, (CASE WHEN id < (SELECT n FROM np) THEN 1.0 / (SELECT n FROM np) ELSE 0 END) * (1 - 0.85 * (o.t IS NOT NULL)::INT) AS b FROM nodes LEFT JOIN o ON id = src){_PR}
SELECT id - (SELECT n FROM np) AS supplier, round(v / (SELECT sum(v) FROM x10), 6) AS score FROM x10 WHERE id >= (SELECT n FROM np) ORDER BY v DESC, id LIMIT 10"""


@query(PAGERANK)
def rk01_pagerank_top_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_supplier(spark, sf_dir)
    scores = ranking.pagerank(graph, tol=0).where(F.col("id") >= graph.n_row)
    return rounded(ranking.top_k(scores, 10).select((F.col("id") - graph.n_row).alias("supplier"), "score"), "score")


@query(f"""WITH {BLOCK}{_rounds(4, "SELECT id, 1.0::DOUBLE AS v FROM nodes", "SELECT id, 0.5 * coalesce(sum(x.v), 0) AS v FROM nodes LEFT JOIN (SELECT e.dst AS id, v FROM e JOIN {x} t ON t.id = e.src WHERE weight <> 0) x USING (id) GROUP BY id")}
SELECT id, round(x1.v + x2.v + x3.v + x4.v, 4) AS score FROM x1 JOIN x2 USING (id) JOIN x3 USING (id) JOIN x4 USING (id)""")
def rk03_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.katz(part_supplier(spark, sf_dir)), "score", digits=4)


@query(f"""WITH {BLOCK} SELECT id, count(src)::BIGINT AS degree, round(coalesce(sum(weight), 0), 6) AS weight FROM nodes LEFT JOIN e ON id = src GROUP BY id""")
def ag01_degrees_and_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = bipartite2undirected(part_supplier(spark, sf_dir))
    return rounded(degrees(block).join(weights(block), "id"), "weight")


@query(f"WITH {TRADE}, a AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) SELECT src, dst, sum(weight) AS weight FROM a GROUP BY 1, 2")
def pr01_directed2undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed2undirected(trade(spark, sf_dir)).edges


@query(f"""WITH {TRADE}, l AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS label FROM nation), t AS (SELECT sum(weight) AS t FROM e),
o AS (SELECT label, sum(weight) AS w FROM e JOIN l ON src = id GROUP BY 1), i AS (SELECT label, sum(weight) AS w FROM e JOIN l ON dst = id GROUP BY 1),
r AS (SELECT (SELECT sum(weight) FROM e JOIN l a ON src = a.id JOIN l b ON dst = b.id WHERE a.label = b.label) / (SELECT t FROM t) AS fit, (SELECT sum(o.w * i.w) FROM o JOIN i USING (label)) / (SELECT t * t FROM t) AS diversity)
SELECT round(fit, 6) AS fit, round(diversity, 6) AS diversity, round(fit - diversity, 6) AS modularity FROM r""")
def ag12_modularity_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("label"))
    return rounded(learning.modularity(trade(spark, sf_dir), labels), "fit", "diversity", "modularity")


@query(f"WITH {TRADE}, l AS (SELECT n_nationkey AS id, n_regionkey::BIGINT AS label FROM nation) SELECT a.label AS src_label, b.label AS dst_label, sum(weight) AS weight FROM e JOIN l a ON src = a.id JOIN l b ON dst = b.id GROUP BY 1, 2")
def ag04_aggregate_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("bigint").alias("label"))
    return learning.aggregate_graph(trade(spark, sf_dir), labels)


@query(f"""WITH {TRADE} , d AS (SELECT src, sum(weight) AS w FROM e GROUP BY 1), a AS (SELECT src, src AS dst, w AS weight FROM d UNION ALL SELECT src, dst, -weight FROM e) SELECT src, dst, sum(weight) AS weight FROM a GROUP BY 1, 2""")
def la01_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.laplacian(trade(spark, sf_dir))


@query(f"""WITH RECURSIVE {SEQ}, d AS (SELECT 0::BIGINT AS id, 0 AS distance UNION SELECT e.dst, distance + 1 FROM d JOIN e ON e.src = d.id WHERE distance < 30)
SELECT nodes.id, coalesce(min(distance), -1)::INT AS distance FROM nodes LEFT JOIN d USING (id) GROUP BY 1""")
def pa01_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.distances(sequence(spark, sf_dir), [0])


@query(f"""WITH {SEQ}{UND}, t AS (SELECT count(*) AS n FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.dst < b.dst),
w AS (SELECT sum(d * (d - 1) / 2) AS w FROM (SELECT count(*) AS d FROM u GROUP BY src)) SELECT round(3 * n / w, 6) AS coefficient FROM t, w""")
def tp06_clustering_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topology.clustering_coefficient(sequence(spark, sf_dir)), "coefficient")


@query(f"""WITH {SEQ}{UND} SELECT count(*) AS n FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.dst < b.dst""")
def tp05_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.count_triangles(sequence(spark, sf_dir))


@query(f"""WITH RECURSIVE {SEQ}{UND}, r AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, u.dst FROM r JOIN u ON u.src = r.other) SELECT id, min(other) AS component FROM r GROUP BY 1""")
def tp01_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.connected_components(sequence(spark, sf_dir))


@query(f"""WITH RECURSIVE {SEQ}, r AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, e.dst FROM r JOIN e ON e.src = r.other)
SELECT a.id, min(a.other) AS component FROM r a JOIN r b ON a.id = b.other AND a.other = b.id GROUP BY 1""")
def tp02_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.strong_components(sequence(spark, sf_dir))


@query(f"""WITH {BLOCK}, x0 AS (SELECT id, 0::BIGINT AS color FROM nodes){"".join(f"""
, s{i} AS (SELECT x.id, x.color, coalesce(string_agg(y.color::VARCHAR, ',' ORDER BY y.color), '') AS near FROM x{i} x LEFT JOIN e ON e.src = x.id LEFT JOIN x{i} y ON y.id = e.dst GROUP BY 1, 2)
, x{i + 1} AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY color, near) AS color FROM s{i})""" for i in range(2))} SELECT id, color FROM x2""")
def tp09_color_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.color_refinement(bipartite2undirected(part_supplier(spark, sf_dir)), 2)


@query(None)
def tp07_core_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.core_decomposition(directed2undirected(sequence(spark, sf_dir), weighted=False))


@query(f"""WITH {PS}, t AS (SELECT src, sum(weight) AS t FROM ps GROUP BY 1), f AS (SELECT dst, count(*) AS f FROM ps WHERE weight > 0 GROUP BY 1)
SELECT src, dst, round(weight / t * ln((SELECT n FROM np) / f), 6) AS weight FROM ps JOIN t USING (src) JOIN f USING (dst)""")
def ag13_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_supplier(spark, sf_dir)
    return rounded(learning.tfidf(graph.edges, graph.n_row), "weight")


_SEEDS = "s AS (SELECT n_nationkey::BIGINT AS id, CASE n_nationkey WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END::DOUBLE AS seed FROM nation)"


@query(f"""WITH {TRADE}, {_SEEDS}, o AS (SELECT src, sum(weight) AS t FROM e GROUP BY 1), p AS (SELECT src, dst, weight / t AS w FROM e JOIN o USING (src))
{_rounds(10, "SELECT id, coalesce(seed, 0.5) AS v FROM s", "SELECT s.id, coalesce(s.seed, m.v, 0) AS v FROM s LEFT JOIN (SELECT p.src AS id, sum(p.w * x.v) AS v FROM p JOIN {x} x ON x.id = p.dst GROUP BY 1) m USING (id)")} SELECT id, round(v, 6) AS value FROM x10""")
def rg02_dirichlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.dirichlet(trade(spark, sf_dir), spark.createDataFrame([(0, 1.0), (1, 0.0)], "id bigint, value double")), "value")


@query(f"""WITH {TRADE}, {_SEEDS}, o AS (SELECT dst, sum(weight) AS t FROM e GROUP BY 1), p AS (SELECT src, dst, weight / t AS w FROM e JOIN o USING (dst))
{_rounds(3, "SELECT id, coalesce(seed, 0.5) AS v FROM s", "SELECT y.id, CASE WHEN m.v IS NULL THEN y.v ELSE 0.5 * y.v + 0.5 * m.v END AS v FROM {x} y LEFT JOIN (SELECT p.dst AS id, sum(p.w * x.v) AS v FROM p JOIN {x} x ON x.id = p.src GROUP BY 1) m USING (id)")} SELECT id, round(v, 6) AS value FROM x3""")
def rg01_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.diffusion(trade(spark, sf_dir), spark.createDataFrame([(0, 1.0), (1, 0.0)], "id bigint, value double")), "value")


@query(f"""WITH {TRADE}, n AS (SELECT src, sqrt(sum(weight * weight)) AS n FROM e GROUP BY 1), w AS (SELECT src, dst, weight / n AS w FROM e JOIN n USING (src)),
c AS (SELECT a.src, b.src AS dst, sum(a.w * b.w) AS s FROM w a JOIN w b USING (dst) GROUP BY 1, 2)
SELECT src, dst, round(s, 6) AS similarity FROM c QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(s, 9) DESC, dst) <= 5""")
def lp01_nearest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.nearest_links(trade(spark, sf_dir), 5), "similarity")


#: Hops that the definitions below follow; the sequence graph's users are a few hops apart.
HOPS = 8


@query(f"""WITH RECURSIVE {SEQ}, d AS (SELECT id AS source, id, 0 AS distance FROM nodes UNION SELECT d.source, e.dst, distance + 1 FROM d JOIN e ON e.src = d.id WHERE distance < {HOPS}),
m AS (SELECT source, id, min(distance) AS distance FROM d GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM nodes) SELECT source AS id, round(CASE WHEN count(*) = any_value(n) THEN (any_value(n) - 1) / sum(distance) ELSE 0 END, 6) AS score FROM m, n GROUP BY 1""")
def rk05_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.closeness(sequence(spark, sf_dir)), "score")


@query(f"""WITH {SEQ}{_rounds(HOPS, "SELECT id AS s, id AS t, 1.0::DOUBLE AS v FROM nodes", "SELECT s, e.dst AS t, sum(v) AS v FROM {x} x JOIN e ON e.src = x.t GROUP BY 1, 2")},
w AS ({" UNION ALL ".join(f"SELECT s, t, {k} AS d, v FROM x{k}" for k in range(HOPS + 1))}), p AS MATERIALIZED (SELECT s, t, min(d) AS d, arg_min(v, d) AS v FROM w GROUP BY 1, 2),
c AS (SELECT a.t AS id, sum(a.v * b.v / p.v) / 2 AS score FROM p a JOIN p b ON a.t = b.s JOIN p ON p.s = a.s AND p.t = b.t WHERE a.d > 0 AND b.d > 0 AND p.d = a.d + b.d AND p.s <> p.t GROUP BY 1)
SELECT nodes.id, round(coalesce(score, 0), 4) AS score FROM nodes LEFT JOIN c USING (id)""")
def rk06_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.betweenness(sequence(spark, sf_dir)), "score", digits=4)


@query(f"""WITH {SEQ}{UND}, o AS (SELECT * FROM u WHERE src < dst)
SELECT count(*) AS n FROM o ab JOIN o bc ON ab.dst = bc.src JOIN o ac ON ac.src = ab.src AND ac.dst = bc.dst JOIN o cd ON cd.src = bc.dst JOIN o ad ON ad.src = ab.src AND ad.dst = cd.dst JOIN o bd ON bd.src = ab.dst AND bd.dst = cd.dst""")
def tp08_count_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.count_cliques(sequence(spark, sf_dir), 4)


def region_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten nations, labelled by their region."""
    rows = _table(spark, sf_dir, "nation").where("n_nationkey < 10")
    return rows.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("label"))


_KNOWN = "k AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS label FROM nation WHERE n_nationkey < 10)"


@query(f"""WITH {TRADE}, {_KNOWN}, o AS (SELECT src, sum(weight) AS t FROM e GROUP BY 1), p AS MATERIALIZED (SELECT src, dst, weight / t AS w FROM e JOIN o USING (src)),
b AS MATERIALIZED (SELECT id, label, (1 - 0.85::DOUBLE * (o.t IS NOT NULL)::INT) / count(*) OVER (PARTITION BY label) AS v FROM k LEFT JOIN o ON id = src){_rounds(10, "SELECT * FROM b", "SELECT id, label, sum(v) AS v FROM (SELECT p.dst AS id, label, 0.85::DOUBLE * w * v AS v FROM p JOIN {x} y ON y.id = p.src UNION ALL SELECT b.id, label, b.v * m.v FROM b JOIN (SELECT label, sum(v) AS v FROM {x} GROUP BY 1) m USING (label)) GROUP BY 1, 2")},
s AS (SELECT id, label, v / sum(v) OVER (PARTITION BY label) AS v FROM x10), r AS (SELECT id, label, v / sum(v) OVER (PARTITION BY id) AS prob FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(v, 12) DESC, label) = 1)
SELECT n_nationkey::BIGINT AS id, coalesce(label, (SELECT min(label) FROM k)) AS label, round(coalesce(prob, 0), 6) AS prob FROM nation LEFT JOIN r ON id = n_nationkey""")
def cf01_pagerank_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classifiers.pagerank_classifier(trade(spark, sf_dir), region_seeds(spark, sf_dir)), "prob")


@query(f"""WITH RECURSIVE {TRADE}, {_KNOWN}, reached AS (SELECT id FROM k UNION SELECT e.dst FROM reached JOIN e ON e.src = reached.id), o AS (SELECT src, sum(weight) AS t FROM e GROUP BY 1), p AS MATERIALIZED (SELECT src, dst, weight / t AS w FROM e JOIN o USING (src)),
g AS (SELECT n_nationkey::BIGINT AS id, c.label, CASE WHEN k.label IS NOT NULL THEN (k.label = c.label)::INT::DOUBLE END AS seed FROM nation CROSS JOIN (SELECT DISTINCT label FROM k) c LEFT JOIN k ON k.id = n_nationkey){_rounds(10, "SELECT id, label, coalesce(seed, 0.5) AS v FROM g", "SELECT g.id, g.label, coalesce(seed, m.v, 0) AS v FROM g LEFT JOIN (SELECT p.src AS id, label, sum(w * v) AS v FROM p JOIN {x} y ON y.id = p.dst GROUP BY 1, 2) m USING (id, label)")},
t AS (SELECT id, label, v - avg(v) OVER (PARTITION BY label) AS v FROM x10), s AS (SELECT id, label, exp(5 * v) / sum(exp(5 * v)) OVER (PARTITION BY id) AS prob FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(v, 9) DESC, label) = 1)
SELECT s.id, CASE WHEN reached.id IS NULL THEN -1 ELSE label END AS label, round(CASE WHEN reached.id IS NULL THEN 0 ELSE prob END, 6) AS prob FROM s LEFT JOIN reached USING (id)""")
def cf02_diffusion_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classifiers.diffusion_classifier(trade(spark, sf_dir), region_seeds(spark, sf_dir)), "prob")


@query(f"""WITH {TRADE}, {_KNOWN}{_rounds(10, "SELECT * FROM k", "SELECT * FROM k UNION ALL SELECT id, label FROM (SELECT e.src AS id, y.label, sum(weight) AS w FROM e JOIN {x} y ON y.id = e.dst WHERE e.src NOT IN (SELECT id FROM k) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1")}
SELECT n_nationkey::BIGINT AS id, coalesce(label, -1) AS label FROM nation LEFT JOIN x10 ON id = n_nationkey""")
def cf03_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifiers.propagation(trade(spark, sf_dir), region_seeds(spark, sf_dir), n_iter=10)


@query(f"""WITH {TRADE}{_rounds(20, "SELECT range AS id, 1.0::DOUBLE AS v FROM range(25)", "SELECT e.dst AS id, sum(e.weight * h.v) AS v FROM e JOIN (SELECT e.src, sum(weight * x.v) AS v FROM e JOIN {x} x ON x.id = e.dst GROUP BY 1) h ON h.src = e.src GROUP BY 1")},
h AS (SELECT e.src AS id, sum(weight * x.v) AS v FROM e JOIN x20 x ON x.id = e.dst GROUP BY 1), s AS (SELECT 'row' AS part, id, v / sqrt(sum(v * v) OVER ()) AS score FROM h UNION ALL SELECT 'col', id, v / sqrt(sum(v * v) OVER ()) FROM x20)
SELECT p.part, range AS id, round(coalesce(score, 0), 6) AS score FROM range(25) CROSS JOIN (VALUES ('row'), ('col')) p(part) LEFT JOIN s ON s.part = p.part AND s.id = range""")
def rk04_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.hits(trade(spark, sf_dir)), "score")


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).cast("bigint").alias("label"))


def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).cast("bigint").alias("label"))


_SIDES = "a AS (SELECT p_partkey AS id, (p_size % 5)::BIGINT AS label FROM part), b AS (SELECT s_suppkey AS id, (s_nationkey % 5)::BIGINT AS label FROM supplier)"


@query(f"""WITH {PS}, {_SIDES}, q AS (SELECT a.label AS la, b.label AS lb, sum(weight) AS w FROM ps JOIN a ON src = a.id JOIN b ON dst = b.id GROUP BY 1, 2), t AS (SELECT sum(w) AS t FROM q),
o AS (SELECT la AS label, sum(w) AS w FROM q GROUP BY 1), i AS (SELECT lb AS label, sum(w) AS w FROM q GROUP BY 1), r AS (SELECT (SELECT sum(w) FROM q WHERE la = lb) / t AS fit, (SELECT sum(o.w * i.w) FROM o JOIN i USING (label)) / (t * t) AS diversity FROM t)
SELECT round(fit, 6) AS fit, round(diversity, 6) AS diversity, round(fit - diversity, 6) AS modularity FROM r""")
def ag12_bipartite_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = learning.modularity(part_supplier(spark, sf_dir), part_labels(spark, sf_dir), supplier_labels(spark, sf_dir))
    return rounded(told, "fit", "diversity", "modularity")


@query(f"WITH {PS}, {_SIDES} SELECT a.label AS src_label, b.label AS dst_label, round(sum(weight), 6) AS weight FROM ps JOIN a ON src = a.id JOIN b ON dst = b.id GROUP BY 1, 2")
def ag04_aggregate_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = learning.aggregate_graph(part_supplier(spark, sf_dir), labels_row=part_labels(spark, sf_dir), labels_col=supplier_labels(spark, sf_dir))
    return rounded(told, "weight")


@query("SELECT p_partkey AS id, (CASE WHEN p_size < 10 THEN 1 ELSE -1 END)::DOUBLE AS value FROM part UNION ALL SELECT s_suppkey + (SELECT count(*) FROM part), -1 FROM supplier")
def pr05_adjacency_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("value"))
    return values.get_adjacency_values(part_supplier(spark, sf_dir), values_row=given)[1]


@query(f"WITH {TRADE}, k AS (SELECT n_nationkey::BIGINT AS old, row_number() OVER (ORDER BY n_nationkey) - 1 AS id FROM nation WHERE n_regionkey = 1) SELECT a.id AS src, b.id AS dst, weight FROM e JOIN k a ON src = a.old JOIN k b ON dst = b.old")
def pr13_submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("id"))
    return values.submatrix(trade(spark, sf_dir), some)[0].edges


@query(f"WITH {TRADE} SELECT src, dst, weight FROM e WHERE src < dst")
def pr14_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.get_dag(trade(spark, sf_dir)).edges


@query(f"WITH {TRADE}, a AS (SELECT src, dst, weight FROM e UNION ALL SELECT range, range, 1 FROM range(25)) SELECT src, dst, sum(weight) AS weight FROM a GROUP BY 1, 2")
def pr21_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.add_self_loops(trade(spark, sf_dir)).edges


@query(f"WITH {TRADE}, w AS (SELECT n_nationkey::BIGINT AS id, coalesce(sum(weight), 0) AS w FROM nation LEFT JOIN e ON src = n_nationkey GROUP BY 1) SELECT id, round(w / sum(w) OVER (), 6) AS prob FROM w")
def pr23_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(values.get_probs("degree", trade(spark, sf_dir)), "prob")


@query("""WITH k AS (SELECT quality AS t, toxic AS p FROM labels WHERE quality >= 0 AND toxic >= 0), l AS (SELECT DISTINCT unnest([t, p]) AS label FROM k),
s AS (SELECT label, (SELECT count(*) FROM k WHERE t = label AND p = label) AS hit, (SELECT count(*) FROM k WHERE t = label) AS nt, (SELECT count(*) FROM k WHERE p = label) AS np FROM l),
r AS (SELECT label, CASE WHEN np > 0 THEN hit / np ELSE 0 END AS precision, CASE WHEN nt > 0 THEN hit / nt ELSE 0 END AS recall FROM s)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r""")
def ag10_f1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "labels").select(F.col("quality").alias("label_true"), F.col("toxic").alias("label_pred"))
    return rounded(learning.f1_scores(pairs), "precision", "recall", "f1")


@query("SELECT quality AS label_true, toxic AS label_pred, count(*) AS n FROM labels WHERE quality >= 0 AND toxic >= 0 GROUP BY 1, 2")
def ag08_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.confusion_matrix(_table(spark, sf_dir, "labels").select(F.col("quality").alias("label_true"), F.col("toxic").alias("label_pred")))


@query(f"""WITH {TRADE}, f AS (SELECT src, sum(weight) AS s FROM e GROUP BY 1) SELECT a.dst AS src, b.dst, round(sum(a.weight * b.weight / f.s), 6) AS weight FROM e a JOIN e b USING (src) JOIN f USING (src) GROUP BY 1, 2""")
def la06_co_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linalg.co_neighbors(trade(spark, sf_dir).transpose()).edges, "weight")


@query(f"WITH {TRADE} SELECT round(sum(weight * weight), 3) AS energy FROM e")
def la10_singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares of all singular values add up to those of the entries."""
    found = linalg.SVDSolver().fit(linalg.matrix(trade(spark, sf_dir)), 25).singular_values_
    return spark.createDataFrame([(float(sum(s * s for s in found)),)], "energy double").select(F.round("energy", 3).alias("energy"))


@query(f"""WITH {TRADE}, r AS (SELECT range AS id, coalesce((SELECT sum(weight) FROM e WHERE src = range), 0) + 2 AS s FROM range(25)), a AS (SELECT x.range AS src, y.range AS dst FROM range(25) x, range(25) y)
SELECT a.dst AS id, round(sum((coalesce(e.weight, 0) + 2 / 25) / r.s), 6) AS value FROM a JOIN r ON r.id = a.src LEFT JOIN e ON e.src = a.src AND e.dst = a.dst GROUP BY 1""")
def la04_normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linalg.normalizer(trade(spark, sf_dir), 2).sum(axis=0), "value")


@query(f"""WITH {TRADE}, {_KNOWN}, n AS (SELECT src, sqrt(sum(weight * weight)) AS n FROM e GROUP BY 1), w AS (SELECT src AS id, dst, weight / n AS w FROM e JOIN n USING (src)),
c AS (SELECT a.id, b.id AS other, sum(a.w * b.w) AS s FROM w a JOIN w b USING (dst) WHERE a.id NOT IN (SELECT id FROM k) AND b.id IN (SELECT id FROM k) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(s, 9) DESC, other) <= 3),
v AS (SELECT c.id, label, count(*) AS n FROM c JOIN k ON k.id = other GROUP BY 1, 2), b AS (SELECT id, label FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)
SELECT n_nationkey::BIGINT AS id, coalesce(k.label, b.label, -1) AS label FROM nation LEFT JOIN k ON k.id = n_nationkey LEFT JOIN b ON b.id = n_nationkey""")
def cf04_nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.nn_classifier(trade(spark, sf_dir), region_seeds(spark, sf_dir), 3)[0]


@query(f"""WITH {TRADE}{_rounds(5, "SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT AS label FROM nation", "SELECT id, coalesce(b.label, y.label) AS label FROM {x} y LEFT JOIN (SELECT id, label FROM (SELECT e.src AS id, z.label, sum(weight) AS w FROM e JOIN {x} z ON z.id = e.dst GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1) b USING (id)")} SELECT id, label FROM x5""")
def cl03_propagation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifiers.propagation_clusters(trade(spark, sf_dir))


@query()
def cl01_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.louvain(sequence(spark, sf_dir))


@query()
def cl02_leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.leiden(sequence(spark, sf_dir))


@query()
def hi01_paris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agglomeration.paris(trade(spark, sf_dir))


@query()
def em04_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.spectral(trade(spark, sf_dir), 2).embedding


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(x::DOUBLE, 0))), 4) AS relu, round(list_sum(list_transform(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE)))), 4) AS sigmoid,
round(exp(list_max(embedding)::DOUBLE) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 6) AS softmax, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings""")
def sc04_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    told = {"relu": (scalar.total(F.transform("x", scalar.relu)), 4), "sigmoid": (scalar.total(F.transform("x", scalar.sigmoid)), 4), "softmax": (F.array_max(scalar.softmax(F.col("x"))), 6), "norm": (scalar.norm(F.col("x")), 5)}
    return rows.select("vec_id", *[F.round(c, d).alias(n) for n, (c, d) in told.items()])


@query("""WITH p AS (SELECT label, list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)) AS e FROM embeddings) SELECT round(avg(-ln(e[label + 1] / list_sum(e))), 6) AS loss FROM p""")
def sc05_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    return rounded(scalar.cross_entropy(_table(spark, sf_dir, "embeddings").select("label", scalar.softmax(x).alias("probs"))), "loss")


@query("SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def sc07_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scalar.min_max_scaled(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"), "c_acctbal")


@query("""WITH c AS (SELECT range AS i FROM range(35)), e AS (SELECT i AS a, i + 1 AS b FROM c WHERE (i + 1) % 7 <> 0 UNION ALL SELECT i, i + 7 FROM c WHERE i < 28) SELECT a AS src, b AS dst, 1.0::DOUBLE AS weight FROM e UNION ALL SELECT b, a, 1.0 FROM e""")
def gn08_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.grid(spark, 5, 7).edges


@query("SELECT range AS src, (range + 1) % 9 AS dst, 1.0::DOUBLE AS weight FROM range(9)")
def gn06_cyclic_digraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.cyclic_digraph(spark, 9).edges


@query("SELECT range AS id, round(cos(2 * pi() * range / 9), 9) AS x, round(sin(2 * pi() * range / 9), 9) AS y FROM range(9)")
def gn05_cyclic_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.cyclic_position(spark, 9), "x", "y", digits=9)


@query(f"""WITH RECURSIVE {SEQ}{UND}, r AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, u.dst FROM r JOIN u ON u.src = r.other), c AS (SELECT id, min(other) AS least FROM r GROUP BY 1) SELECT id, dense_rank() OVER (ORDER BY least) - 1 AS label FROM c""")
def tp01_component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.get_connected_components(sequence(spark, sf_dir))


@query(f"""WITH RECURSIVE {SEQ}, d AS (SELECT 0::BIGINT AS id, 0 AS distance UNION SELECT e.dst, distance + 1 FROM d JOIN e ON e.src = d.id WHERE distance < {HOPS}), m AS (SELECT id, min(distance) AS distance FROM d GROUP BY 1)
SELECT src, dst, weight FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.distance < b.distance""")
def pa02_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.get_shortest_path(sequence(spark, sf_dir), 0).edges


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
