"""Queries over a link graph of suppliers: consecutive selected lines of an order link their suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..session import durable

ROUNDS = 10
NATION = 3


def supplier_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity >= 45 AND l_discount <= 0.03")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    links = lines.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst"))
    nodes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    return graph.Graph(nodes, graph.simple_links(links.filter("dst IS NOT NULL"), nodes))


def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("doc_id"), F.floor(F.col("s_acctbal") / 1000).alias("score"))


def fixed_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topic_pagerank(supplier_graph(spark, sf_dir), topic(spark, sf_dir), rounds=ROUNDS, tolerance=0)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter(F.col("s_nationkey") == NATION).select(F.col("s_suppkey").alias("id"))
    made = supplier_graph(spark, sf_dir)
    return graph.hits(graph.Graph(made.nodes, durable(made.links)), root, rounds=ROUNDS, tolerance=0)


def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("doc_id", F.col("authority").alias("score"))


def graph_edges(spark, sf_dir):
    return supplier_graph(spark, sf_dir).links


def graph_stats(spark, sf_dir):
    return graph.graph_stats(supplier_graph(spark, sf_dir))


def graph_degrees(spark, sf_dir):
    return graph.degrees(supplier_graph(spark, sf_dir))


def pagerank_fixed_iter(spark, sf_dir):
    return fixed_pagerank(spark, sf_dir).withColumn("score", F.round("score", 6))


def pagerank_converged(spark, sf_dir):
    return graph.topic_pagerank(supplier_graph(spark, sf_dir), topic(spark, sf_dir)).withColumn("score", F.round("score", 6))


def pagerank_top(spark, sf_dir):
    rows = fixed_pagerank(spark, sf_dir).orderBy(F.desc(F.round("score", 6)), "doc_id").limit(10)
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("doc_id"), "s_name")
    return rows.join(names, "doc_id", "left").select("doc_id", "s_name", F.round("score", 6).alias("score"))


def hits_authority(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", F.round("authority", 5).alias("authority"))


def hits_hub(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", F.round("hub", 5).alias("hub"))


def link_components(spark, sf_dir):
    return graph.components(supplier_graph(spark, sf_dir).links, "src", "dst")


_LINKS = """nodes AS MATERIALIZED (SELECT s_suppkey AS id, greatest(coalesce(floor(s_acctbal / 1000), 1), 1) AS weight FROM supplier),
links AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS dst FROM lineitem WHERE l_quantity >= 45 AND l_discount <= 0.03)
WHERE dst IS NOT NULL AND src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"""


def _pagerank_sql(rounds: int = ROUNDS, tolerance: float = 0) -> str:
    """CTE body: doc_id, score. Ranks stay as they are after the round that moves less than `tolerance` in all."""
    parts = [_LINKS, "o AS MATERIALIZED (SELECT src, count(*) AS out FROM links GROUP BY src)", "g AS MATERIALIZED (SELECT count(*) AS n, sum(weight) AS mass FROM nodes)", "r0 AS MATERIALIZED (SELECT id, weight, 1.0::DOUBLE / n AS rank FROM nodes CROSS JOIN g)"]
    for i in range(1, rounds + 1):
        new = f"0.85 * (coalesce(x.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o)) / g.n) + 0.15 * r.weight / g.mass"
        if tolerance and i > 1:
            new = f"CASE WHEN (SELECT sum(abs(a.rank - b.rank)) FROM r{i - 1} a JOIN r{i - 2} b USING (id)) < {tolerance} THEN r.rank ELSE {new} END"
        parts.append(f"""r{i} AS MATERIALIZED (SELECT r.id, r.weight, {new} AS rank
FROM r{i - 1} r CROSS JOIN g LEFT JOIN (SELECT l.dst, sum(q.rank / o.out) AS got FROM links l JOIN r{i - 1} q ON q.id = l.src JOIN o ON o.src = l.src GROUP BY l.dst) x ON x.dst = r.id)""")
    return f"WITH {', '.join(parts)} SELECT id AS doc_id, rank AS score FROM r{rounds}"


def hits_sql(root: str, rounds: int = ROUNDS, tolerance: float = 0) -> str:
    """CTE body: doc_id, hub, authority. root: a query of ids. Scores stay after the round that moves both less than `tolerance`."""
    first = lambda side, other: f"(SELECT {other} FROM (SELECT {other}, row_number() OVER (PARTITION BY {side} ORDER BY {other}) AS n FROM links WHERE {side} IN (SELECT id FROM root)) WHERE n <= 50)"
    parts = [_LINKS, f"root AS MATERIALIZED ({root})", f"base AS MATERIALIZED (SELECT id FROM (SELECT id FROM root UNION {first('src', 'dst')} UNION {first('dst', 'src')}) WHERE id IN (SELECT id FROM nodes))"]
    parts += ["near AS MATERIALIZED (SELECT src, dst FROM links WHERE src IN (SELECT id FROM base) AND dst IN (SELECT id FROM base))", "h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS auth FROM base)"]
    for i in range(1, rounds + 1):
        parts.append(f"""x{i} AS MATERIALIZED (SELECT b.id, coalesce(h.v, 0) AS hub, coalesce(a.v, 0) AS auth FROM base b LEFT JOIN (SELECT n.src, sum(p.auth) AS v FROM near n JOIN h{i - 1} p ON p.id = n.dst GROUP BY n.src) h ON h.src = b.id
LEFT JOIN (SELECT n.dst, sum(p.hub) AS v FROM near n JOIN h{i - 1} p ON p.id = n.src GROUP BY n.dst) a ON a.dst = b.id)""")
        hub, auth = (f"{c} / coalesce(nullif((SELECT sqrt(sum({c} * {c})) FROM x{i}), 0), 1)" for c in ("hub", "auth"))
        if tolerance and i > 1:
            still = f"(SELECT sum(abs(a.hub - b.hub)) < {tolerance} AND sum(abs(a.auth - b.auth)) < {tolerance} FROM h{i - 1} a JOIN h{i - 2} b USING (id))"
            parts.append(f"h{i} AS MATERIALIZED (SELECT id, CASE WHEN {still} THEN p.hub ELSE {hub.replace('hub /', 'x.hub /', 1)} END AS hub, CASE WHEN {still} THEN p.auth ELSE {auth.replace('auth /', 'x.auth /', 1)} END AS auth FROM x{i} x JOIN h{i - 1} p USING (id))")
        else:
            parts.append(f"h{i} AS MATERIALIZED (SELECT id, {hub} AS hub, {auth} AS auth FROM x{i})")
    return f"WITH {', '.join(parts)} SELECT id AS doc_id, hub, auth AS authority FROM h{rounds}"


PAGERANK_SQL, HITS_SQL = _pagerank_sql(), hits_sql(f"SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = {NATION}")
QUERIES = {f.__name__: f for f in (graph_edges, graph_stats, graph_degrees, pagerank_fixed_iter, pagerank_converged, pagerank_top, hits_authority, hits_hub, link_components)}
ORACLES = {
    "graph_edges": f"WITH {_LINKS} SELECT src, dst FROM links",
    "graph_stats": f"""WITH {_LINKS}, o AS (SELECT src AS id, count(*) AS n FROM links GROUP BY src), i AS (SELECT dst AS id, count(*) AS n FROM links GROUP BY dst)
SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM links) AS n_edges, coalesce((SELECT max(n) FROM o), 0) AS max_out_degree, (SELECT id FROM o ORDER BY n DESC, id LIMIT 1) AS max_out_node,
coalesce((SELECT max(n) FROM i), 0) AS max_in_degree, (SELECT id FROM i ORDER BY n DESC, id LIMIT 1) AS max_in_node, round((SELECT count(*) FROM links) / (SELECT count(*) FROM nodes), 2) AS avg_out_degree""",
    "graph_degrees": f"""WITH {_LINKS} SELECT id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY src) o ON o.src = id LEFT JOIN (SELECT dst, count(*) AS n FROM links GROUP BY dst) i ON i.dst = id""",
    "pagerank_fixed_iter": f"SELECT doc_id, round(score, 6) AS score FROM ({PAGERANK_SQL})",
    "pagerank_converged": f"SELECT doc_id, round(score, 6) AS score FROM ({_pagerank_sql(graph.ROUNDS, graph.TOLERANCE)})",
    "pagerank_top": f"SELECT doc_id, s_name, round(score, 6) AS score FROM ({PAGERANK_SQL}) JOIN supplier ON s_suppkey = doc_id ORDER BY round(score, 6) DESC, doc_id LIMIT 10",
    "hits_authority": f"SELECT doc_id, round(authority, 5) AS authority FROM ({HITS_SQL})",
    "hits_hub": f"SELECT doc_id, round(hub, 5) AS hub FROM ({HITS_SQL})",
    "link_components": f"""WITH RECURSIVE {_LINKS}, e AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT node, min(other) AS component FROM reach GROUP BY node""",
}
