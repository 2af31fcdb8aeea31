"""Inverted index, document store and statistics as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import remove_stop_words, term_counts, tokenize
from ..session import durable
from ..sources.pages import load_table, save_tables

PREVIEW = 500


@dataclass
class Index:
    """postings (term, doc_id, tf), doc_store (a row for each page), stats (one row: n, avg_dl); lengths if they are written."""

    postings: DataFrame
    doc_store: DataFrame
    stats: DataFrame
    analyzer: str = "full"
    lengths: DataFrame | None = None

    def settled(self) -> Index:
        """The same with its pages' lengths written once, from which the statistics are made; previews are left where they are."""
        lengths = durable(self.doc_store.select("doc_id", "doc_len"))
        return Index(self.postings, self.doc_store, corpus_stats(lengths), self.analyzer, lengths)

    def doc_lengths(self) -> DataFrame:
        """doc_id, doc_len."""
        return self.doc_store.select("doc_id", "doc_len") if self.lengths is None else self.lengths

    def save(self, folder: str) -> None:
        save_tables(folder, postings=self.postings, doc_store=self.doc_store, corpus_stats=self.stats)

    @staticmethod
    def load(spark: SparkSession, folder: str, analyzer: str = "full") -> Index:
        return Index(*(load_table(spark, folder, t) for t in ("postings", "doc_store", "corpus_stats")), analyzer)


def build_index(pages: DataFrame, analyzer: str = "full") -> Index:
    """Index title and text of pages with doc_id, url, final_url, title, clean_text, geology_score."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("clean_text", F.lit("")))
    docs = pages.withColumn("_text", text)
    postings = term_counts(docs, "doc_id", "_text", analyzer)
    tokens = tokenize(F.col("_text"))
    length = F.size(tokens if analyzer == "raw" else remove_stop_words(tokens))
    store = docs.select("doc_id", "url", "final_url", "title", F.substring("clean_text", 1, PREVIEW).alias("clean_text_preview"), length.alias("doc_len"), F.coalesce("geology_score", F.lit(0)).alias("geology_score"))
    return Index(postings, store, corpus_stats(store), analyzer)


def corpus_stats(store: DataFrame) -> DataFrame:
    """n counts all rows, empty ones too; avg_dl is 0 without rows."""
    return store.agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.sum("doc_len"), F.count("*")), F.lit(0.0)).alias("avg_dl"))


def term_df(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def doc_terms(postings: DataFrame) -> DataFrame:
    """The forward index: a document's distinct terms, sorted."""
    return postings.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def prune_vocab(postings: DataFrame, stats: DataFrame, min_df: int = 2, max_df_ratio: float = 0.85) -> DataFrame:
    """term, df of the terms that are neither rare nor everywhere."""
    most = F.greatest(F.lit(1), F.floor(F.col("n") * max_df_ratio))
    return term_df(postings).crossJoin(F.broadcast(stats.select("n"))).filter((F.col("df") >= min_df) & (F.col("df") <= most)).drop("n")


def tfidf(tf: Column, df: Column, n: Column) -> Column:
    """(1 + log10 tf) log10(n / df); 0 where a count is."""
    return F.when((tf > 0) & (df > 0), (1 + F.log10(tf)) * F.log10(n / df)).otherwise(F.lit(0.0))


def tfidf_weights(postings: DataFrame, stats: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, doc_id, w; `terms` (term, df) restricts the vocabulary."""
    terms = term_df(postings) if terms is None else terms.select("term", "df")
    return postings.join(terms, "term").crossJoin(F.broadcast(stats.select("n"))).select("term", "doc_id", tfidf(F.col("tf"), F.col("df"), F.col("n")).alias("w"))


def term_cosines(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, cosine for pairs of terms (a, b) by their full weight vectors; 0 where a norm is.

    Of each pair the term in fewer documents is expanded, and meets the other one by term and document.
    """
    norms = weights.groupBy("term").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("n"))
    rows = pairs.join(norms.toDF("a", "na", "ca"), "a", "left").join(norms.toDF("b", "nb", "cb"), "b", "left")
    rarer = F.col("ca") <= F.col("cb")
    both = rows.filter((F.col("na") > 0) & (F.col("nb") > 0)).select("a", "b", F.when(rarer, F.col("a")).otherwise(F.col("b")).alias("r"), F.when(rarer, F.col("b")).otherwise(F.col("a")).alias("f"))
    one, two = weights.select(F.col("term").alias("r"), "doc_id", F.col("w").alias("wr")), weights.select(F.col("term").alias("f"), "doc_id", F.col("w").alias("wf"))
    dots = both.join(one, "r").join(two, ["f", "doc_id"]).groupBy("a", "b").agg(F.sum(F.col("wr") * F.col("wf")).alias("dot"))
    rows = rows.join(dots, ["a", "b"], "left")
    return rows.select("a", "b", F.when((F.col("na") > 0) & (F.col("nb") > 0), F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb"))).otherwise(F.lit(0.0)).alias("cosine"))
