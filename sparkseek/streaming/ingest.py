"""Streams: page ingest with deduplication, and windows over a query log or events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..functions.urls import normalize_url
from ..operators.crawl import judged
from ..sources.pages import LOG, PAGE


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Page batches as they arrive."""
    return spark.readStream.schema(PAGE).json(folder)


def usable_pages(pages: DataFrame, late: str = "1 hour", keywords: list[str] | None = None) -> DataFrame:
    """Pages that pass all gates, one of each normalised URL and one of each text within the watermark."""
    rows = pages.withColumns({"event_time": F.timestamp_seconds("fetch_time"), "url": F.coalesce(normalize_url(F.col("url")), F.lit("")), "html": F.lit(""), "content_hash": content_hash(F.col("clean_text"))})
    rows = judged(rows, keywords).filter(F.col("stop").isNull()).drop("stop", "html")
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["url"]).dropDuplicatesWithinWatermark(["content_hash"])


def write_batches(rows: DataFrame, folder: str, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Each micro-batch under its own number; a batch that is run again overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if also:
            also(batch, number)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LOG).json(folder).withColumn("at", F.to_timestamp("timestamp"))


def windowed(rows: DataFrame, time: str, by: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """window_start, by, n and (with `value`) total in tumbling or sliding windows; for streams and tables."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    sums = [F.round(F.sum(value), 4).alias("total")] if value else []
    return rows.groupBy(frame, by).agg(F.count("*").alias("n"), *sums).select(F.col("window.start").alias("window_start"), by, "n", *(["total"] if value else []))


def sessions(rows: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """by, session_start, session_end, n: runs of rows with gaps below `gap`."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    rows = rows.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return rows.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
