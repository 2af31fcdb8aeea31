"""Crawl dataflow: frontier, gates, funnel, deduplication, edges and numbering, a round at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import parse_pages
from ..functions.text import content_hash, is_utility_title, link_priority, topic_score
from ..functions.urls import first_by, is_utility_url, origin
from ..session import durable, placed, small
from ..sources import fetch
from ..sources import pages as files
from .seen import BUCKETS, SeenSet

MIN_CHARS, TOPIC, PRIORITY, DEPTH, OUTLINKS = 200, 6, 8, 8, 200
AGENT = "sparkseek"
FRONT = ("url", "depth", "score", "discovered_from", "queue", "seq")


def keep_new(candidates: DataFrame, queued: DataFrame, visited: DataFrame, depth: int = DEPTH, priority: int = PRIORITY) -> DataFrame:
    """Candidates (url, depth, score, discovered_from, seq) that may be queued, with their queue.

    Empty URLs, deeper ones, and those queued or visited go; of equal URLs the first stays.
    """
    rows = candidates.join(queued.select("url"), "url", "left_anti").join(visited.select("url"), "url", "left_anti")
    return queueable(rows, depth, priority)


def queueable(candidates: DataFrame, depth: int = DEPTH, priority: int = PRIORITY) -> DataFrame:
    """The first candidate of each URL that is not empty or too deep, with its queue."""
    rows = candidates.filter((F.coalesce("url", F.lit("")) != "") & (F.col("depth") <= depth))
    return first_by(rows, "url", "seq").withColumn("queue", F.when(F.col("score") >= priority, "high").otherwise("normal"))


def pop(frontier: DataFrame, n: int) -> DataFrame:
    """The next n: all high ones before normal ones, each in order of arrival."""
    return frontier.orderBy((F.col("queue") != "high").cast("int"), "seq").limit(n)


def allowed(urls: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """The rows (url) that robots rules allow. robots: origin, status, body; an origin without a row allows all.

    A URL is allowed if the agent or `*` is; a file that isn't 200 allows all, and so does one that fails.
    """
    rows = urls.withColumn("_o", origin(F.col("url"))).join(robots.select(F.col("origin").alias("_o"), "status", "body"), "_o", "left")

    def ok(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held: dict[str, RobotFileParser] = {}
        for url, status, body in batches:
            out = []
            for u, s, b in zip(url, status, body, strict=True):
                if s != 200 or not b:
                    out.append(True)
                    continue
                if b not in held:
                    if len(held) >= 10_000:
                        held.clear()
                    held[b] = RobotFileParser()
                    held[b].parse(b.splitlines())
                out.append(held[b].can_fetch(agent, u) or held[b].can_fetch("*", u))
            yield pd.Series(out, dtype=bool)

    return rows.filter(F.pandas_udf(ok, "boolean")("url", "status", "body")).select(*urls.columns)


def judged(pages: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Parsed pages with their topic score and the first gate that stops them (`stop`; null if none does).

    Gates in order: status, html, length, utility, topic.
    """
    score = topic_score(F.col("title"), F.col("clean_text"), F.col("url"), keywords)
    utility = is_utility_url(F.col("url")) | is_utility_title(F.col("title"))
    stop = F.when(~F.coalesce(F.col("status") == 200, F.lit(False)), "status").when(F.col("html").isNull(), "html").when(F.length("clean_text") < MIN_CHARS, "length").when(utility, "utility").when(score < TOPIC, "topic")
    return pages.withColumns({"geology_score": score, "stop": stop})


def first_contents(pages: DataFrame, order: str, seen: DataFrame | None = None) -> DataFrame:
    """Pages whose text comes first in `order`; seen: hashes of earlier rounds."""
    rows = pages.withColumn("content_hash", content_hash(F.col("clean_text")))
    rows = rows if seen is None else rows.join(seen.select("content_hash"), "content_hash", "left_anti")
    return first_by(rows, "content_hash", order)


def numbered(pages: DataFrame, order: str, first: int = 1, name: str = "doc_id") -> DataFrame:
    """Dense ids in `order`, from `first` up; every row gets one."""
    return placed(pages, order, name="_rank").withColumn(name, F.col("_rank") + first).drop("_rank")


def page_edges(pages: DataFrame) -> DataFrame:
    """source_doc_id, source_url, target_url, anchor_text, pos of all links that are no utility pages."""
    rows = pages.select(F.col("doc_id").alias("source_doc_id"), F.col("url").alias("source_url"), "geology_score", "depth", "anchor_map", F.posexplode("outlinks").alias("pos", "target_url"))
    rows = rows.filter(~is_utility_url(F.col("target_url")))
    return rows.withColumn("anchor_text", F.coalesce(F.try_element_at("anchor_map", "target_url"), F.lit(""))).drop("anchor_map")


def candidates(edges: DataFrame, keywords: list[str] | None = None, most: int = OUTLINKS) -> DataFrame:
    """Frontier candidates: of each page its first links, one deeper, with their priority and order."""
    order = Window.partitionBy("source_doc_id").orderBy("pos")
    rows = edges.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    score = link_priority(F.col("geology_score"), F.col("anchor_text"), F.col("target_url"), keywords)
    return rows.select(F.col("target_url").alias("url"), (F.col("depth") + 1).alias("depth"), score.alias("score"), F.col("source_doc_id").alias("discovered_from"), F.struct("source_doc_id", "pos").alias("seq"))


def gate_counts() -> list[Column]:
    """What a funnel counts before deduplication, over judged rows."""
    past = lambda *gates: F.count_if(~F.coalesce(F.col("stop").isin(*gates), F.lit(False)))
    at = lambda gate: F.count_if(F.col("stop") == gate)
    counts = {"attempted": F.count("*"), "fetched_ok": past("status"), "parsed": past("status", "html"), "long_enough": past("status", "html", "length"), "filtered_utility": at("utility"), "filtered_topic": at("topic"), "kept_after_quality": F.count_if(F.col("stop").isNull())}
    return [c.alias(name) for name, c in counts.items()]


def funnel(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of cumulative counts. pages: judged rows; kept: those left after deduplication."""
    counts = pages.agg(*gate_counts())
    final = kept.agg(F.count("*").alias("kept_after_dedup"))
    return counts.crossJoin(F.broadcast(final)).withColumn("duplicates_content", F.col("kept_after_quality") - F.col("kept_after_dedup")).withColumn("final_usable", F.col("kept_after_dedup"))


def observed(pages: DataFrame) -> tuple[DataFrame, Callable[[int], dict]]:
    """The judged rows, and a function that gives the funnel once they have been written, from the number that was kept.

    The counts before deduplication are taken by the write itself; nothing reads the pages a second time.
    """
    seen = Observation()

    def counts(kept: int) -> dict:
        found = seen.get
        return found | {"kept_after_dedup": kept, "duplicates_content": found["kept_after_quality"] - kept, "final_usable": kept}

    return pages.observe(seen, *gate_counts()), counts


def crawl_round(fetched: DataFrame, frontier: DataFrame, visited: DataFrame, hashes: DataFrame | None = None, robots: DataFrame | None = None, first_id: int = 1, size: int = 5000, keywords: list[str] | None = None) -> dict[str, DataFrame]:
    """One batch of the crawl over already fetched pages (url, final_url, html, status, content_type, fetch_time).

    Gives pages, edges, frontier (what is queued next), visited, hashes and the counters. Retrieval itself is
    outside: `fetched` is its result table.
    """
    batch = pop(frontier, size).join(visited.select("url"), "url", "left_anti")
    batch = batch if robots is None else allowed(batch, robots)
    pages = parse_pages(batch.join(fetched, "url"), "html", "url")
    rows = judged(pages, keywords)
    kept = numbered(first_contents(rows.filter(F.col("stop").isNull()), "seq", hashes), "seq", first_id)
    edges = page_edges(kept)
    seen = visited.select("url").unionByName(batch.select("url")).distinct()
    rest = frontier.join(batch.select("url"), "url", "left_anti")
    queued = keep_new(candidates(edges, keywords), rest, seen)
    new_hashes = kept.select("content_hash")
    return {"pages": kept, "edges": edges.select("source_doc_id", "source_url", "target_url", "anchor_text"), "rest": rest, "queued": queued, "visited": seen, "hashes": new_hashes if hashes is None else hashes.select("content_hash").unionByName(new_hashes), "funnel": funnel(rows, kept)}


class Crawl:
    """A crawl's folder: what each version of its state names, in `seen`, and the exported batches.

    A version names the queue, the runs of the sets of known URLs (queued or visited) and of text hashes, the batches
    that were exported, the counters, and `pending`: a round's URLs and what was retrieved for them. A round makes two
    versions: one when its pages have been retrieved, one when they are exported. A crawl that is lost anywhere
    goes on from the last version; what a broken step wrote is named by none, so it is overwritten or vacuumed, no
    page is lost or exported twice, and none is retrieved again once the round's first version is in place.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder
        self.known, self.hashes = (SeenSet(spark, f"{folder}/seen", key, buckets) for key in ("url", "content_hash"))
        self.versions = self.known.versions
        self.now = self.versions.read()

    def put(self, kind: str, rows: DataFrame) -> tuple[str, DataFrame]:
        """Write a table under a new name."""
        name = self.versions.fresh(kind)
        rows.write.parquet(self.versions.at(name))
        return name, self.read(name, rows)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        scan = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return scan.parquet(self.versions.at(name))

    def commit(self, **changes: object) -> None:
        now = self.now | changes
        tables = [now["frontier"], *(now["pending"] or {}).values()]
        runs = [r["name"] for kind in ("known", "hashes") for r in now[kind]["runs"]]
        self.versions.commit(self.versions.latest() + 1, now, [*tables, *runs])
        self.now = self.versions.read()
        self.versions.vacuum(keep=2)

    def start(self, seeds: DataFrame) -> None:
        """The first version: the seeds in the queue."""
        found = seeds.select("url", F.lit(0).alias("depth"), F.lit(PRIORITY).alias("score"), F.lit(None).cast("long").alias("discovered_from"), (F.col("seq") if "seq" in seeds.columns else F.monotonically_increasing_id()).alias("seq"))
        none = self.spark.createDataFrame([], "url STRING")
        name, frontier = self.put("frontier", keep_new(found, none, none).select(*FRONT))
        self.now = {"hashes": {"runs": []}, "batches": [], "stats": {}, "next_doc_id": 1, "next_seq": 1 << 40}
        self.commit(frontier=name, known={"runs": [self.known.write(frontier)]}, pending=None)

    def retrieve(self, size: int, fetch_pages: Callable, fetch_rules: Callable) -> bool:
        """Take the next URLs of the queue and retrieve what robots rules allow; whether there were any."""
        asked, batch = self.put("asked", pop(self.read(self.now["frontier"]), size))
        if batch.isEmpty():
            return False
        _, rules = self.put("rules", fetch_rules(batch.select("url")))
        pages, _ = self.put("fetched", fetch_pages(allowed(batch.select("url"), rules)))
        self.commit(pending={"asked": asked, "fetched": pages})
        return True

    def export(self, keywords: list[str] | None, start: float) -> None:
        """Judge, number and export what was retrieved, and queue its links."""
        asked, fetched = self.read(self.now["pending"]["asked"]), self.read(self.now["pending"]["fetched"])
        rows, counts = observed(judged(parse_pages(asked.join(fetched, "url"), "html", "url"), keywords).drop("html"))
        rows = durable(rows)
        fresh = durable(first_contents(rows.filter(F.col("stop").isNull()), "seq"))
        new = durable(self.hashes.new(fresh, self.now["hashes"]))
        first, number = self.now["next_doc_id"], len(self.now["batches"]) + 1
        kept = durable(numbered(fresh.join(new, "content_hash", "left_semi"), "seq", first))
        n = kept.count()
        stats = {k: self.now["stats"].get(k, 0) + v for k, v in counts(n).items()}
        edges = durable(page_edges(kept))
        columns = [c.split()[0] for c in files.PAGE.split(", ")]
        timings = {"batch_elapsed_sec": round(time.time() - start, 2)}
        files.export_batch(kept.select(*columns), edges.select("source_doc_id", "source_url", "target_url", "anchor_text"), self.folder, number, stats, timings, time.time())
        found = durable(queueable(candidates(edges, keywords)))
        found = found.join(self.known.new(found, self.now["known"]), "url", "left_semi")
        queued = durable(numbered(found, "seq", self.now["next_seq"], "place").withColumn("seq", F.col("place")).select(*FRONT))
        rest = self.read(self.now["frontier"]).join(asked.select("url"), "url", "left_anti").select(*FRONT)
        name, _ = self.put("frontier", rest.unionByName(queued))
        known = self.known.with_run(self.now["known"], self.known.write(queued))
        hashes = self.hashes.with_run(self.now["hashes"], self.hashes.write(new))
        self.commit(frontier=name, known=known, hashes=hashes, pending=None, stats=stats, batches=[*self.now["batches"], number], next_doc_id=first + n, next_seq=self.now["next_seq"] + queued.count(), saved_at=time.time())

    def pages(self) -> DataFrame:
        """The pages of the batches that the last version names."""
        paths = [f"{self.folder}/pages_batch_{n:04d}" for n in self.now.get("batches", ())]
        return files.read_jsonl(self.spark, paths, files.PAGE) if paths else self.spark.createDataFrame([], files.PAGE)


def crawl(spark: SparkSession, seeds: DataFrame, folder: str, rounds: int, size: int = 5000, keywords: list[str] | None = None, retrieve: Callable[[DataFrame], DataFrame] | None = None, robots: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> dict:
    """Rounds of a crawl from seeds (url; seq, if there is one, is their order), or from where the folder's last crawl ended; gives its counters.

    A round takes up to `size` URLs, retrieves and judges them, writes a numbered batch of pages and edges, and
    queues their links. The queue's narrow rows are written in each round; known URLs and hashes are only added to. `buckets`, the
    same for all rounds, is by how many hashes of hosts the sets are cut (see `seen`).
    """
    own = Crawl(spark, folder, buckets)
    if not own.now:
        own.start(seeds)
    for _ in range(rounds):
        start = time.time()
        if not own.now["pending"] and not own.retrieve(size, retrieve or fetch.fetch, robots or fetch.fetch_robots):
            break
        own.export(keywords, start)
    return own.now["stats"]


def host_delay(urls: DataFrame, delay: float = 1.0) -> DataFrame:
    """wait: seconds until a URL's turn when each host is asked once in `delay` seconds, in order of seq.

    URLs are ranked by host and seq, all in one range-sorted table, and a host's first rank is taken off; so a host of
    any size is ranked by as many tasks as its rows fill. Hosts' first ranks are one narrow row each.
    """
    rows = placed(urls.withColumn("_h", F.coalesce(origin(F.col("url")), F.lit(""))), "_h", "seq")
    first = rows.groupBy("_h").agg(F.min("_rank").alias("_first"))
    return rows.join(small(durable(first)), "_h").withColumn("wait", (F.col("_rank") - F.col("_first")) * F.lit(delay)).drop("_h", "_rank", "_first")


def stop_counts(pages: DataFrame) -> DataFrame:
    """stop, pages: how many each gate stopped."""
    gate: Column = F.coalesce("stop", F.lit("kept"))
    return pages.groupBy(gate.alias("stop")).agg(F.count("*").alias("pages"))
