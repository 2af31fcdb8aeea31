"""An index that takes additions, replacements and deletions: immutable segments, tombstones, merges and snapshots.

A batch of pages becomes one segment: postings ranged and sorted by term, and the pages' store. Nothing that was
written changes. A page that is replaced or deleted gets a tombstone, a narrow row with its id and the number of the version
that buried it; it hides the page in segments of lower numbers only, so that a page may come again. Every version's
document names its segments and tombstones and has the number of live pages and of their words, so that N and the mean
length of a snapshot cost no job. Segments of one size tier are merged when there are `fanout` of them: live rows are
written anew, and tombstones that hide nothing any more go. A row is so rewritten about log(pages) times in all.

A snapshot is an `Index` like any other. Its postings are one scan of all segments' files; those of segments older than
a tombstone pass an anti-join with the tombstones, broadcast when their number, which the document has, is small.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import partitions_for, small_of
from ..sources.versions import Versions
from .index import Index, build_index

POSTINGS = "term STRING, doc_id LONG, tf LONG, seq LONG"
STORE = "doc_id LONG, url STRING, final_url STRING, title STRING, clean_text_preview STRING, doc_len INT, geology_score INT, seq LONG"
TOMBSTONES = "doc_id LONG, doc_len INT, seq LONG"
FANOUT = 4


class SegmentedIndex:
    def __init__(self, spark: SparkSession, folder: str, analyzer: str = "full", fanout: int = FANOUT):
        self.spark, self.versions, self.analyzer, self.fanout = spark, Versions(spark, folder), analyzer, fanout

    # --- Reading ---

    def snapshot(self, version: int | None = None) -> Index:
        """The index as of a version, by default the last one."""
        now = self.versions.read(version)
        n, words = now.get("n", 0), now.get("words", 0)
        stats = self.spark.createDataFrame([(n, words / n if n else 0.0)], "n LONG, avg_dl DOUBLE")
        return Index(self._live(now, "postings", POSTINGS).drop("seq"), self._live(now, "store", STORE).drop("seq"), stats, self.analyzer)

    def _live(self, now: dict, kind: str, schema: str) -> DataFrame:
        """The rows of all segments that no tombstone hides."""
        buried = max((t["seq"] for t in now.get("tombstones", ())), default=0)
        old, young = ([self.versions.at(s["name"]) + f"/{kind}" for s in now.get("segments", ()) if (s["seq"] < buried) == b] for b in (True, False))
        scan = self.spark.read.schema(schema)
        rows = scan.parquet(*young) if young else self.spark.createDataFrame([], schema)
        if not old:
            return rows
        dead = self._tombstones(now).groupBy(F.col("doc_id").alias("_id")).agg(F.max("seq").alias("_seq"))
        dead = small_of(dead, sum(t["docs"] for t in now["tombstones"]))
        left = scan.parquet(*old).join(dead, (F.col("doc_id") == F.col("_id")) & (F.col("seq") < F.col("_seq")), "left_anti")
        return left.unionByName(rows) if young else left

    def _tombstones(self, now: dict) -> DataFrame:
        return self.spark.read.schema(TOMBSTONES).parquet(*[self.versions.at(t["name"]) for t in now["tombstones"]])

    # --- Writing ---

    def add(self, pages: DataFrame) -> int:
        """Add pages, as `build_index` takes them, or replace those of the same doc_id; gives the new version.

        A batch with two rows of one doc_id, or a null one, is refused.
        """
        now, version = self._next()
        part = self._segment(build_index(pages, self.analyzer), version)
        ids = self.spark.read.schema(STORE).parquet(self.versions.at(part["name"]) + "/store").select("doc_id")
        twice = ids.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").first()
        if twice:
            raise ValueError(f"doc_id {twice['doc_id']} is null or stands in a batch twice")
        return self._commit(version, now, [*now.get("segments", ()), part], self._bury(now, ids, version), part)

    def delete(self, ids: DataFrame) -> int:
        """Delete the pages of these ids (doc_id); ids that the index doesn't hold are ignored."""
        now, version = self._next()
        return self._commit(version, now, now.get("segments", []), self._bury(now, ids.select("doc_id").distinct(), version))

    def merge(self, whole: bool = False) -> int:
        """Merge the segments of every tier that has `fanout` of them, until none has, or all segments; gives the last version."""
        while True:
            now, version = self._next()
            tiers: dict[int, list[dict]] = {}
            for s in now.get("segments", ()):
                tiers.setdefault(int(math.log(max(s["docs"], 1), self.fanout) + 1e-9), []).append(s)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if whole:
                full = now["segments"] if len(now.get("segments", ())) > 1 or now.get("tombstones") else None
            if not full:
                return version - 1
            own = now | {"segments": full}
            part = self._segment(Index(self._live(own, "postings", POSTINGS), self._live(own, "store", STORE), None), version)
            rest = [s for s in now["segments"] if s not in full]
            self._commit(version, now, [*rest, part])

    def vacuum(self, keep: int = 1) -> list[str]:
        return self.versions.vacuum(keep)

    def _next(self) -> tuple[dict, int]:
        version = self.versions.latest()
        return self.versions.read(version), version + 1

    def _segment(self, rows: Index, version: int) -> dict:
        """Write a segment; its number is that of the version that it begins with."""
        name = self.versions.fresh("segment")
        seq = F.lit(version).cast("long").alias("seq")
        columns = [c.split()[0] for c in STORE.split(", ")[:-1]]
        rows.doc_store.select(*[F.col(c) for c in columns], seq).write.parquet(self.versions.at(name) + "/store")
        docs, words = self._sizes(self.versions.at(name) + "/store", STORE)
        # Postings are no more than words; a frequent term's fill several partitions.
        postings = rows.postings.select("term", "doc_id", "tf", seq).repartitionByRange(partitions_for(self.spark, words), "term", "doc_id")
        postings.sortWithinPartitions("term", "doc_id").write.parquet(self.versions.at(name) + "/postings")
        return {"name": name, "seq": version, "docs": docs, "words": words}

    def _bury(self, now: dict, ids: DataFrame, version: int) -> dict | None:
        """Tombstones of those ids that the version before holds alive."""
        if not now.get("segments"):
            return None
        name = self.versions.fresh("tombstones")
        live = self._live(now, "store", STORE).select("doc_id", "doc_len").join(ids, "doc_id", "left_semi")
        live.withColumn("seq", F.lit(version).cast("long")).write.parquet(self.versions.at(name))
        docs, words = self._sizes(self.versions.at(name), TOMBSTONES)
        return {"name": name, "seq": version, "docs": docs, "words": words} if docs else None

    def _sizes(self, path: str, schema: str) -> tuple[int, int]:
        return tuple(self.spark.read.schema(schema).parquet(path).agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first())

    def _commit(self, version: int, now: dict, segments: list[dict], buried: dict | None = None, added: dict | None = None) -> int:
        """The new version, without empty segments and tombstones that can't hide anything any more."""
        segments = [s for s in segments if s["docs"]]
        oldest = min((s["seq"] for s in segments), default=version)
        tombstones = [t for t in (*now.get("tombstones", ()), buried) if t and t["seq"] > oldest]
        none = {"docs": 0, "words": 0}
        n, words = (now.get(k, 0) + (added or none)[c] - (buried or none)[c] for k, c in (("n", "docs"), ("words", "words")))
        return self.versions.commit(version, {"segments": segments, "tombstones": tombstones, "n": n, "words": words}, [x["name"] for x in (*segments, *tombstones)])
