"""Link graph, its statistics, topic PageRank, HITS and components.

Iterations keep one narrow row a node. Every few rounds the rows are written to the shared folder and read
again, so a plan stays short and a lost executor costs one round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import url_map
from ..session import drop_table, durable, small, small_of

DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
HITS_ROUNDS, HITS_TOLERANCE, NEIGHBOURS = 50, 1e-6, 50


@dataclass
class Graph:
    """nodes (id), links (src, dst): a simple digraph without self links."""

    nodes: DataFrame
    links: DataFrame


def build_graph(pages: DataFrame, edges: DataFrame) -> Graph:
    """Every page is a node; edges join pages whose source is known and whose target URL names a page."""
    nodes = pages.select(F.col("doc_id").alias("id")).distinct()
    links = edges.join(url_map(pages).select(F.col("url").alias("target_url"), F.col("doc_id").alias("dst")), "target_url")
    return Graph(nodes, simple_links(links.select(F.col("source_doc_id").alias("src"), "dst"), nodes))


def simple_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct links between two different nodes."""
    links = links.filter("src <> dst").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return links.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def graph_stats(graph: Graph) -> DataFrame:
    """Counts, largest degrees and their (smallest) nodes, mean out-degree."""
    def most(side: str, name: str) -> DataFrame:
        degrees = graph.links.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n"))
        best = degrees.agg(F.max(F.struct("n", (-F.col("id")).alias("i"))).alias("m"))
        return best.select(F.coalesce("m.n", F.lit(0)).alias(f"max_{name}_degree"), (-F.col("m.i")).alias(f"max_{name}_node"))

    nodes, links = graph.nodes.agg(F.count("*").alias("n_nodes")), graph.links.agg(F.count("*").alias("n_edges"))
    rows = nodes.crossJoin(links).crossJoin(most("src", "out")).crossJoin(most("dst", "in"))
    return rows.withColumn("avg_out_degree", F.when(F.col("n_nodes") > 0, F.round(F.col("n_edges") / F.col("n_nodes"), 2)).otherwise(F.lit(0.0)))


def degrees(graph: Graph) -> DataFrame:
    out = graph.links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = graph.links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    rows = graph.nodes.join(out, "id", "left").join(into, "id", "left")
    return rows.select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def topic_pagerank(graph: Graph, topic: DataFrame | None = None, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, score. Jumps go to nodes by max(topic score, 1); the mass of nodes without links is spread evenly.

    topic: doc_id, score. The vector that first changes by less than `tolerance` in all is the result.
    """
    links = durable(graph.links)
    out = links.groupBy("src").agg(F.count("*").alias("out"))
    weight = F.lit(1.0) if topic is None else F.greatest(F.coalesce("t", F.lit(1)), F.lit(1)).cast("double")
    nodes = graph.nodes.join(out.withColumnRenamed("src", "id"), "id", "left")
    if topic is not None:
        nodes = nodes.join(topic.select(F.col("doc_id").alias("id"), F.col("score").alias("t")), "id", "left")
    nodes = durable(nodes.select("id", F.coalesce("out", F.lit(0)).alias("out"), weight.alias("weight")))
    n, mass, dangling = nodes.agg(F.count("*"), F.sum("weight"), F.sum((F.col("out") == 0).cast("long"))).first()
    if not n:
        return nodes.select(F.col("id").alias("doc_id"), F.lit(0.0).alias("score"))
    ranks, loose = nodes.withColumn("rank", F.lit(1.0 / n)), dangling / n
    for _ in range(rounds):
        given = links.join(small_of(ranks.select(F.col("id").alias("src"), F.try_divide("rank", "out").alias("share")), n), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        new = damping * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / n)) + (1 - damping) * F.col("weight") / mass
        step = durable(ranks.join(given, "id", "left").select("id", "out", "weight", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        moved, loose = step.agg(F.sum("moved"), F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0))).first()
        drop_table(ranks) if "moved" in ranks.columns else None
        ranks = step
        if moved < tolerance:
            break
    return ranks.select(F.col("id").alias("doc_id"), F.col("rank").alias("score"))


def hits(graph: Graph, root: DataFrame, rounds: int = HITS_ROUNDS, tolerance: float = HITS_TOLERANCE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, hub, authority over the base set: the roots (id) and the smallest `neighbours` of each on both sides.

    Both scores are updated from the round before and scaled to length 1; a zero vector stays.
    """
    def first(side: str, other: str) -> DataFrame:
        near = graph.links.join(root.select(F.col("id").alias(side)), side, "left_semi")
        order = Window.partitionBy(side).orderBy(other)
        return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= neighbours).select(F.col(other).alias("id"))

    base = root.select("id").unionByName(first("src", "dst")).unionByName(first("dst", "src")).distinct()
    base = durable(base.join(graph.nodes, "id", "left_semi"))
    links = durable(simple_links(graph.links, base))
    n = base.count()
    scores = base.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("auth"))
    for _ in range(rounds if n else 0):
        now = small_of(scores, n)
        auth = links.join(now.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        hub = links.join(now.select(F.col("id").alias("dst"), "auth"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("auth").alias("h"))
        step = durable(scores.join(auth, "id", "left").join(hub, "id", "left").select("id", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a"), F.col("hub").alias("oh"), F.col("auth").alias("oa")))
        hn, an = step.agg(F.sqrt(F.sum(F.col("h") * F.col("h"))), F.sqrt(F.sum(F.col("a") * F.col("a")))).first()
        scores = step.select("id", (F.col("h") / (hn or 1.0)).alias("hub"), (F.col("a") / (an or 1.0)).alias("auth"), "oh", "oa")
        dh, da = scores.agg(F.sum(F.abs(F.col("hub") - F.col("oh"))), F.sum(F.abs(F.col("auth") - F.col("oa")))).first()
        scores = scores.select("id", "hub", "auth")
        if dh < tolerance and da < tolerance:
            break
    return scores.select(F.col("id").alias("doc_id"), "hub", F.col("auth").alias("authority"))


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that links reach, by hanging nodes on their smallest neighbour.

    The longest path shrinks by a constant factor a round; links that don't settle in `rounds` are an error.
    """
    e = durable(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter("x <> y").distinct())
    before = None
    for _ in range(rounds):
        sides = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = sides.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        wide = sides.join(least, "x").filter("y > x AND y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.filter("m <> x").select("x", F.col("m").alias("y"))).distinct()
        least = wide.groupBy("x").agg(F.min("y").alias("m"))
        both = wide.join(least, "x")
        old, e = e, durable(both.filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y"))).distinct())
        drop_table(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(e.select(F.col("y").alias("node"), F.col("y").alias("component"))).distinct()
