"""The engine as one object: build or load, search, expand, cluster shapes, capabilities, command line."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import added_terms, search_url
from .operators import cluster, expand, graph, rank
from .operators.index import Index, build_index
from .session import durable
from .sources import pages as files

METHODS = ("tfidf", "bm25", "pagerank", "hits")
#: What an engine without clusters answers when it is asked for them.
NO_CLUSTERS = {"available": False, "message": "The collection has not been clustered.", "required": ["flat clusters", "two agglomerative clusterings", "labels for results"], "clusters": [], "results": []}


@dataclass
class SearchEngine:
    index: Index
    links: graph.Graph
    pagerank: DataFrame
    log: str | None = None
    labels: DataFrame | None = None

    @staticmethod
    def build(pages: DataFrame, edges: DataFrame, folder: str | None = None, analyzer: str = "full") -> SearchEngine:
        """Index, graph and PageRank of pages and edges, saved to `folder` if one is given."""
        index = build_index(pages, analyzer)
        links = graph.build_graph(pages, edges)
        if folder:
            index.save(folder)
            files.save_tables(folder, nodes=links.nodes, links=links.links, graph_stats=graph.graph_stats(links))
            index = Index.load(pages.sparkSession, folder, analyzer)
            links = graph.Graph(*(files.load_table(pages.sparkSession, folder, t) for t in ("nodes", "links")))
        else:
            index = Index(durable(index.postings), durable(index.doc_store), durable(index.stats), analyzer)
            links = graph.Graph(durable(links.nodes), durable(links.links))
        ranks = graph.topic_pagerank(links, index.doc_store.select("doc_id", F.col("geology_score").alias("score")))
        if folder:
            files.save_tables(folder, pagerank=ranks)
        return SearchEngine(index, links, ranks)

    @staticmethod
    def load(spark: SparkSession, folder: str, analyzer: str = "full") -> SearchEngine:
        nodes, links, ranks = (files.load_table(spark, folder, t) for t in ("nodes", "links", "pagerank"))
        return SearchEngine(Index.load(spark, folder, analyzer), graph.Graph(nodes, links), ranks)

    def ranked(self, query: str, method: str = "tfidf", k: int = rank.TOP_K) -> DataFrame:
        """doc_id, score by one of METHODS."""
        if method == "tfidf":
            return rank.tfidf_rank(self.index, query, k)
        if method == "bm25":
            return rank.bm25(self.index, query, k)
        if method == "pagerank":
            return rank.pagerank_search(self.index, query, self.pagerank, k)
        if method == "hits":
            root = rank.matches(self.index, rank.query_terms(self.index, query)).select(F.col("doc_id").alias("id")).distinct()
            found = graph.hits(self.links, durable(root)).select("doc_id", F.col("authority").alias("score"))
            return rank.top(found, k)
        raise ValueError(f"unknown method {method!r}")

    def search(self, query: str, method: str = "tfidf", k: int = rank.TOP_K) -> DataFrame:
        return rank.format_results(self.ranked(query, method, k), self.index.doc_store)

    def combined(self, query: str, k: int = rank.TOP_K) -> DataFrame:
        """The ensemble of TF-IDF, blended and authority lists."""
        most = rank.fetch_size(k)
        return rank.ensemble({m: self.ranked(query, m, most) for m in ("tfidf", "pagerank", "hits")}, k)

    def relevance(self, query: str, model: str = "vector", k: int = rank.TOP_K) -> DataFrame:
        """By the service's model names; an unknown one is `vector`."""
        if model == "combined":
            return rank.format_results(self.combined(query, k), self.index.doc_store)
        return self.search(query, {"pagerank": "pagerank", "hits": "hits"}.get(model, "tfidf"), k)

    def answer(self, query: str, model: str = "vector") -> dict:
        """time, model label, results; or an error. The query is logged if a log is set."""
        query, model = query.strip(), model.strip().lower()
        if not query:
            return {"error": "Query cannot be empty."}
        start, out = time.perf_counter(), {}
        try:
            rows = [r.asDict() for r in self.relevance(query, model).orderBy("rank").collect()]
        except Exception as error:  # the service answers, whatever a search runs into
            rows, out = [], {"error": str(error)}
        elapsed = time.perf_counter() - start
        if self.log:
            files.log_query(self.index.postings.sparkSession, self.log, query, model, elapsed, datetime.now(UTC).isoformat())
        return {"time": round(elapsed, 3), "model": rank.LABELS.get(model, model.upper()), "results": rows, **out}

    def expanded(self, query: str, method: str = "rocchio") -> dict:
        """The expansion with the words that it added to the query."""
        if not query.strip():
            return {"error": "Query cannot be empty."}
        found = expand.expand(self.index, query, method)
        return found | {"added": added_terms(found["original_query"], found["expanded_query"])}

    def clusters(self, query: str, label: str = "flat_cluster", k: int = rank.TOP_K) -> dict:
        """Definitions of the clusters that a query's results fall into, and the results with their clusters, in order of both."""
        if not query.strip():
            return {"error": "Query cannot be empty."}
        if self.labels is None:
            return dict(NO_CLUSTERS)
        try:
            found = durable(cluster.clustered_results(self.search(query, k=k), self.labels, label))
            shapes = [r.asDict() for r in cluster.cluster_counts(found, label).collect()]
            rows = [r.asDict() for r in found.orderBy(label, "rank").drop(label).collect()]
        except Exception as error:  # the service answers, whatever a search runs into
            return {"clusters": [], "results": [], "error": str(error)}
        return {"available": True, "clusters": shapes, "results": rows}

    def term_report(self, terms: list[str], sample: int = 4) -> DataFrame:
        """term, n_docs, postings: the first few as doc:tf; terms without postings have none."""
        asked = self.index.postings.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term STRING")
        own = self.index.postings.filter(F.col("term").isin(terms))
        first = own.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).filter(F.col("n") <= sample)
        shown = F.transform(F.array_sort(F.collect_list(F.struct("n", "doc_id", "tf"))), lambda p: F.concat_ws(":", p["doc_id"], p["tf"]))
        rows = asked.join(own.groupBy("term").agg(F.count("*").alias("n_docs")), "term", "left").join(first.groupBy("term").agg(F.array_join(shown, " ").alias("postings")), "term", "left")
        return rows.select("term", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("postings", F.lit("")).alias("postings"))

    def summary(self) -> DataFrame:
        """One row: pages, mean length, terms, and the graph's statistics."""
        terms = self.index.postings.agg(F.count_distinct("term").alias("n_terms"))
        return self.index.stats.crossJoin(terms).crossJoin(graph.graph_stats(self.links))

    def pagerank_report(self, k: int = 10) -> DataFrame:
        return rank.top(self.pagerank, k).join(self.index.doc_store.select("doc_id", "url", "title"), "doc_id", "left").orderBy(*rank.by_score())

    def examples(self, terms: list[str]) -> DataFrame:
        """Postings of a few terms, for inspection."""
        return self.index.postings.filter(F.col("term").isin(terms)).orderBy("term", F.desc("tf"), "doc_id")


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes of what a folder holds, by name; a table's bytes are those of its files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().getName(), system.getContentSummary(f.getPath()).getLength()) for f in system.listStatus(at))
    return spark.createDataFrame(found, "name STRING, bytes LONG")


def capabilities(spark: SparkSession) -> DataFrame:
    rows = [("relevance", True, ["vector", "pagerank", "hits", "combined"]), ("clustering", True, ["flat", "birch", "agg_average", "agg_complete"]), ("expansion", True, list(expand.METHODS)), ("comparison", True, ["google", "bing"])]
    return spark.createDataFrame(rows, "module STRING, available BOOLEAN, methods ARRAY<STRING>")


def outside_searches(queries: DataFrame) -> DataFrame:
    """query, engine, search_url of the outside engines."""
    both = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), search_url(F.col("query"), e).alias("search_url")) for e in ("google", "bing")]))
    return queries.select("query", both.alias("x")).select("query", "x.*")


def main(argv: list[str] | None = None) -> None:
    from .session import session

    args = argparse.ArgumentParser(description="Build a search index over crawled batches, or query one.")
    args.add_argument("--build", metavar="BATCHES", help="folder of page and edge batches")
    args.add_argument("--index", required=True, metavar="FOLDER")
    args.add_argument("-q", "--query")
    args.add_argument("-m", "--method", default="tfidf", choices=METHODS)
    args.add_argument("-k", "--top-k", type=int, default=rank.TOP_K)
    given = args.parse_args(argv)
    spark = session()
    if given.build:
        engine = SearchEngine.build(files.load_pages(spark, given.build), files.load_edges(spark, given.build), given.index)
    else:
        engine = SearchEngine.load(spark, given.index)
    if given.query:
        engine.search(given.query, given.method, given.top_k).orderBy("rank").show(given.top_k, False)


if __name__ == "__main__":
    main()
