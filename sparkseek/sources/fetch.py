"""Retrieval of pages over HTTP as a table: polite, with retries, a row for every URL whatever happens."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import origin

AGENT = "sparkseek/1.0"
TIMEOUT, RETRIES, BACKOFF, DELAY = 20.0, 3, 0.5, 1.0
AGAIN = frozenset({429, 500, 502, 503, 504})
FETCHED = "url STRING, final_url STRING, status INT, content_type STRING, html STRING, error STRING, fetch_time DOUBLE"


def get(url: str, agent: str = AGENT, timeout: float = TIMEOUT, retries: int = RETRIES, backoff: float = BACKOFF, only_html: bool = True) -> tuple:
    """One row of FETCHED. The body is kept for status 200 and, with only_html, for HTML."""
    final, status, kind, body, error = url, None, None, None, None
    for attempt in range(retries + 1):
        error = None
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                final, status, kind = answer.geturl(), answer.status, answer.headers.get("Content-Type", "")
                if status == 200 and (not only_html or "text/html" in kind.lower()):
                    body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as refused:
            final, status, kind = refused.geturl(), refused.code, refused.headers.get("Content-Type", "")
            refused.close()
        except (OSError, ValueError) as failed:
            error = f"{type(failed).__name__}: {failed}"
        if error is None and status not in AGAIN or attempt == retries:
            break
        time.sleep(backoff * 2**attempt)
    return url, final, status, kind, body, error, time.time()


def fetch(urls: DataFrame, delay: float = DELAY, only_html: bool = True, **options) -> DataFrame:
    """FETCHED rows of the table's urls. A host's URLs stay in one task, which waits `delay` between them."""

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            rows = []
            for host, url in zip(batch["_h"], batch["url"], strict=True):
                if host == before:
                    time.sleep(delay)
                before = host
                rows.append(get(url, only_html=only_html, **options))
            out = pd.DataFrame(rows, columns=["url", "final_url", "status", "content_type", "html", "error", "fetch_time"])
            yield out.assign(status=out["status"].astype("Int32"))

    rows = urls.select("url", origin(F.col("url")).alias("_h")).repartition("_h").sortWithinPartitions("_h")
    return rows.mapInPandas(fetched, FETCHED)


def fetch_robots(urls: DataFrame, **options) -> DataFrame:
    """origin, status, body of the robots file of every origin of the urls."""
    files = urls.select(F.concat(origin(F.col("url")), F.lit("/robots.txt")).alias("url")).distinct()
    rows = fetch(files, 0.0, only_html=False, **options)
    return rows.select(F.regexp_replace("url", "/robots.txt$", "").alias("origin"), "status", F.col("html").alias("body"))
