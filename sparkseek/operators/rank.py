"""Ranking: TF-IDF cosine, BM25, blends with link scores, ensembles and result rows.

Scores of equal size are ordered by doc_id. A query's terms are a few rows and are broadcast; a semi-join on
them stands below the index's aggregation, so only their postings are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analyzed
from ..session import durable
from .index import Index, tfidf

K1, B = 1.2, 0.75
TOP_K, SNIPPET = 10, 300
RANK_WEIGHT, PAGERANK_WEIGHT, PAGERANK_SCALE = 0.7, 0.3, 1000
ENSEMBLE = {"tfidf": 0.5, "pagerank": 0.3, "hits": 0.2}
LABELS = {"vector": "TF-IDF", "pagerank": "PageRank", "hits": "HITS Authority", "combined": "Hybrid Ensemble"}


def query_terms(index: Index, query: str) -> DataFrame:
    """term, qtf of the analyzed query."""
    spark = index.postings.sparkSession
    rows = spark.createDataFrame([(0, query.strip())], "id INT, text STRING")
    return analyzed(rows, "id", "text", index.analyzer).groupBy("term").agg(F.count("*").alias("qtf"))


def matches(index: Index, terms: DataFrame) -> DataFrame:
    """term, doc_id, tf, df, qtf of the postings of the terms."""
    own = index.postings.join(F.broadcast(terms.select("term")), "term", "left_semi")
    # Counting tf keeps both uses of these rows alike, so that their one exchange is read twice.
    df = own.groupBy("term").agg(F.count("tf").alias("df"))
    return own.join(F.broadcast(df), "term").join(F.broadcast(terms), "term")


def by_score() -> list[Column]:
    """Order of results: scores that differ by less than a sum's rounding are equal, and the smaller id is first."""
    return [F.desc(F.round("score", 9)), F.col("doc_id")]


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(*by_score()).limit(k)


def bm25_part(k1: float = K1, b: float = B) -> Column:
    """A posting's part of a score, from qtf, tf, df, n, doc_len and avg_dl."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    length = F.coalesce(F.col("doc_len").cast("double"), F.col("avg_dl"))
    return F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / F.col("avg_dl")))


def bm25_scores(index: Index, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score; a query term counts as often as it occurs in the query."""
    rows = matches(index, query_terms(index, query)).crossJoin(F.broadcast(index.stats))
    rows = rows.join(index.doc_lengths(), "doc_id", "left")
    return rows.groupBy("doc_id").agg(F.sum(bm25_part(k1, b)).alias("score"))


def bm25(index: Index, query: str, k: int = TOP_K, k1: float = K1, b: float = B) -> DataFrame:
    return top(bm25_scores(index, query, k1, b), k)


def tfidf_scores(index: Index, query: str) -> DataFrame:
    """doc_id, score: cosine with the query over the query's terms only; a query term counts once."""
    rows = matches(index, query_terms(index, query)).crossJoin(F.broadcast(index.stats))
    rows = rows.withColumns({"qw": tfidf(F.lit(1), F.col("df"), F.col("n")), "dw": tfidf(F.col("tf"), F.col("df"), F.col("n"))})
    norm = rows.select("term", "qw").distinct().agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    docs = rows.groupBy("doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("dot"), F.sqrt(F.sum(F.col("dw") * F.col("dw"))).alias("dn"))
    length = F.col("qn") * F.col("dn")
    return docs.crossJoin(F.broadcast(norm)).select("doc_id", (F.col("dot") / F.when(length > 0, length).otherwise(F.lit(1.0))).alias("score"))


def tfidf_rank(index: Index, query: str, k: int = TOP_K) -> DataFrame:
    return top(tfidf_scores(index, query), k)


def blend(ranked: DataFrame, pagerank: DataFrame, k: int = TOP_K) -> DataFrame:
    """Scores over their maximum, blended with a page's rank; pages without a rank have 0."""
    best = F.max("score").over(Window.partitionBy())
    base = F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0))
    rows = ranked.withColumn("base", base).join(pagerank.select("doc_id", F.col("score").alias("pr")), "doc_id", "left")
    return top(rows.select("doc_id", (RANK_WEIGHT * F.col("base") + PAGERANK_WEIGHT * F.coalesce("pr", F.lit(0.0)) * PAGERANK_SCALE).alias("score")), k)


def pagerank_search(index: Index, query: str, pagerank: DataFrame, k: int = TOP_K) -> DataFrame:
    """The first 5 k by BM25, blended."""
    return blend(bm25(index, query, 5 * k), pagerank, k)


def normalized(ranked: DataFrame) -> DataFrame:
    """Scores over their maximum; all 0 if that is not above 0."""
    best = F.max("score").over(Window.partitionBy())
    return ranked.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0)))


def ensemble(lists: dict[str, DataFrame], k: int = TOP_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of normalised lists; scores are rounded before and after, as the lists show them."""
    weights, rows = weights or ENSEMBLE, None
    for name, ranked in lists.items():
        part = normalized(ranked.withColumn("score", F.round("score", 6))).select("doc_id", (F.col("score") * weights[name]).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return top(rows.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score")), k)


def fetch_size(k: int) -> int:
    """How many of each list an ensemble of k takes."""
    return max(4 * k, 30)


def format_results(ranked: DataFrame, store: DataFrame) -> DataFrame:
    """rank, doc_id, score (6 places), url (final one if there is one), title, snippet. The k rows are written, and only their pages taken from the store."""
    ranked = durable(ranked)
    store = store.join(F.broadcast(ranked.select("doc_id")), "doc_id", "left_semi")
    order = Window.orderBy(*by_score())  # over the k rows of a result
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    url = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"), F.lit(""))
    rows = ranked.withColumn("rank", F.row_number().over(order)).join(store, "doc_id", "left")
    return rows.select("rank", "doc_id", F.round("score", 6).alias("score"), url.alias("url"), text("title").alias("title"), F.substring(text("clean_text_preview"), 1, SNIPPET).alias("snippet"))


def precision_at(ranked: DataFrame, judged: DataFrame, k: int) -> Column | DataFrame:
    """precision: share of the first k results that are judged relevant (doc_id, relevant 0/1)."""
    return top(ranked, k).join(judged, "doc_id", "left").agg((F.sum(F.coalesce("relevant", F.lit(0))) / k).alias("precision"))
