"""Files of pages, edges, batches, seeds, indexes, graphs, clusters and the query log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..functions.urls import is_utility_page, normalize_url
from .versions import Versions

PAGE = "doc_id LONG, url STRING, final_url STRING, title STRING, clean_text STRING, content_type STRING, fetch_time DOUBLE, status INT, depth INT, geology_score INT"
EDGE = "source_doc_id LONG, source_url STRING, target_url STRING, anchor_text STRING"
BATCH = "batch INT, generated_at DOUBLE, pages_in_batch INT, edges_in_batch INT, stats MAP<STRING,LONG>, timings MAP<STRING,DOUBLE>"
STATE = "next_doc_id LONG, next_batch_idx INT, crawl_start_ts DOUBLE, saved_at DOUBLE, stats MAP<STRING,LONG>"
FRONTIER = "url STRING, depth INT, score INT, discovered_from LONG, queue STRING"
LOG = "query STRING, method STRING, elapsed_sec DOUBLE, timestamp STRING"
CRAWLED = "status INT, url STRING, title STRING, text STRING"
MIN_WORDS = 20


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines, plain or gzipped. Broken lines fail the read, or are dropped if `tolerant`."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "gzip").json(path)


def load_pages(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """All page batches without utility pages. Gzip doesn't split, so `parts` deals the rows anew."""
    pages = read_jsonl(spark, f"{folder}/pages_batch_*", PAGE)
    pages = pages.repartition(parts) if parts else pages
    return pages.filter(~is_utility_page(F.col("url"), F.col("final_url"), F.col("title")))


def load_edges(spark: SparkSession, folder: str) -> DataFrame:
    return read_jsonl(spark, f"{folder}/edges_batch_*", EDGE)


def load_for_clustering(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """url, title, text of good pages of enough words; text is title and text, cleaned."""
    rows = clusterable(read_jsonl(spark, path, CRAWLED, tolerant=True))
    return rows.limit(limit) if limit is not None else rows


def clusterable(pages: DataFrame) -> DataFrame:
    """Status 200, text and URL not empty, and MIN_WORDS words of the cleaned title and text."""
    some = (F.col("status") == 200) & (F.coalesce("text", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    text = clean_text(F.concat_ws(" ", F.coalesce("title", F.lit("")), "text"))
    return pages.filter(some).select("url", "title", text.alias("text")).filter(F.size(F.filter(F.split("text", " "), lambda w: w != "")) >= MIN_WORDS)


def load_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Normalised URLs of a text file without blank and comment lines; no rows if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "url STRING")
    lines = spark.read.text(path).select(F.btrim("value").alias("v")).filter((F.col("v") != "") & ~F.col("v").startswith("#"))
    return lines.select(normalize_url(F.col("v")).alias("url")).filter("url <> ''")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not empty."""
    return spark.read.text(path).select(F.btrim("value").alias("value")).filter("value <> ''")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Sorted distinct lines, gzipped."""
    df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").option("compression", "gzip").text(path)


def write_document(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document with sorted keys, put in place by the file committer."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False),)], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, default: dict | None = None) -> dict | None:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"]) if exists(spark, path) else default


def export_batch(pages: DataFrame, edges: DataFrame, folder: str, number: int, stats: dict, timings: dict, now: float) -> list[str]:
    """Pages, edges and metadata of a crawl batch under its number; gives the three paths."""
    spark, paths = pages.sparkSession, [f"{folder}/{kind}_batch_{number:04d}" for kind in ("pages", "edges", "metadata")]
    write_jsonl(pages, paths[0])
    write_jsonl(edges, paths[1])
    counts = {"pages_in_batch": spark.read.schema(PAGE).json(paths[0]).count(), "edges_in_batch": spark.read.schema(EDGE).json(paths[1]).count()}
    write_document(spark, {"batch": number, "generated_at": now, **counts, "stats": stats, "timings": timings}, paths[2])
    return paths


def save_tables(folder: str, **tables: DataFrame) -> None:
    """Parquet tables; one with a `term` is ranged and sorted by it, so that a term reads few row groups."""
    for name, df in tables.items():
        if "term" in df.columns:
            df = df.repartitionByRange("term").sortWithinPartitions("term")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def write_cluster_csv(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").option("header", True).csv(path)


def log_query(spark: SparkSession, path: str, query: str, method: str, elapsed: float, timestamp: str) -> None:
    """Append one entry to the query log."""
    spark.createDataFrame([(query, method, round(elapsed, 4), timestamp)], LOG).coalesce(1).write.mode("append").json(path)


def tail_log(log: DataFrame, limit: int = 50) -> tuple[int, DataFrame]:
    """Number of entries, and the last ones (500 at most), oldest first."""
    last = log.orderBy(F.desc("timestamp")).limit(max(0, min(limit, 500)))
    return log.count(), last.orderBy("timestamp")


def save_crawl(folder: str, frontier: DataFrame, visited: DataFrame, hashes: DataFrame, state: dict) -> None:
    """Frontier with its queues, seen URLs and text hashes, and the counters, as one version: all of them or none."""
    own = Versions(frontier.sparkSession, folder)
    names = {kind: own.fresh(kind) for kind in ("frontier", "visited_urls", "content_hashes")}
    write_jsonl(frontier, own.at(names["frontier"]))
    write_lines(visited, "url", own.at(names["visited_urls"]))
    write_lines(hashes, "content_hash", own.at(names["content_hashes"]))
    own.commit(own.latest() + 1, names | {"state": state}, list(names.values()))


def load_crawl(spark: SparkSession, folder: str, depth: int = 8) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """What save_crawl wrote last, or an empty crawl; queued URLs are checked for depth, repeats and visits again."""
    own = Versions(spark, folder)
    now = own.read()
    if not now:
        return spark.createDataFrame([], f"{FRONTIER}, seq LONG"), spark.createDataFrame([], "url STRING"), spark.createDataFrame([], "content_hash STRING"), {}
    visited, hashes = (read_lines(spark, own.at(now[name])).withColumnRenamed("value", c) for name, c in (("visited_urls", "url"), ("content_hashes", "content_hash")))
    frontier = read_jsonl(spark, own.at(now["frontier"]), f"{FRONTIER}, seq LONG").filter((F.col("depth") <= depth) & (F.col("url") != ""))
    frontier = frontier.groupBy("url").agg(F.min_by(F.struct("depth", "score", "discovered_from", "queue", "seq"), "seq").alias("f")).select("url", "f.*")
    return frontier.join(visited, "url", "left_anti"), visited, hashes, now["state"]
