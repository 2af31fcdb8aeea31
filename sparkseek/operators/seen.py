"""A set of URLs that only grows: runs of cells with a Bloom filter each, so that a question reads few of them.

Each batch of new URLs becomes a run. A URL's bucket is a hash of its host, so that a round of the crawl, which asks for
few hosts, meets few buckets; a bucket of many URLs in a run is cut by a hash of the URL into parts of about CELL, so
that no host makes a cell large. Bucket and part name a cell: a folder of the run with its sorted URLs, and a row of
the run's filters (BITS bits a URL, HASHES of them set).

To ask, URLs meet the filters of their own cells; of those that may be held, the cells are read and joined by the URL
itself, so the answer is exact. What is read depends on what is asked and on the number of runs, which merging keeps at
FANOUT for each power of FANOUT in size, and not on how many URLs the set holds. A merge reads the URLs and writes new
cells and filters of the right size. The driver sees names of cells only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import origin
from ..session import durable
from ..sources.versions import Versions

BUCKETS = 256
#: URLs of a cell, about, the bits of its filter for each, and how many of them a URL sets: 1 % are taken for others.
CELL, BITS, HASHES = 100_000, 10, 7
FANOUT = 4
FILTERS = "bucket INT, part INT, parts INT, n LONG, size LONG, bits BINARY"


def bucket_of(value: Column, buckets: int) -> Column:
    """By the host of a URL; what has none is spread by itself."""
    return F.pmod(F.xxhash64(F.coalesce(F.nullif(origin(value), F.lit("")), value)), F.lit(buckets)).cast("int")


def spots(high: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
    """The bits (HASHES x values) of values that are given by two hashes."""
    step = low.astype(np.uint64) | np.uint64(1)
    return (high.astype(np.uint64)[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(size)


def filter_of(high: np.ndarray, low: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, bool)
    bits[spots(high, low, size).ravel().astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, high: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
    at = spots(high, low, size).astype(np.int64)
    data = np.frombuffer(bits, np.uint8)
    return ((data[at >> 3] >> (7 - (at & 7))) & 1).astype(bool).all(0)


class SeenSet:
    """Values of one column (`key`), mostly URLs; others are spread over buckets by their own hash."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "url", buckets: int = BUCKETS, cell: int = CELL, fanout: int = FANOUT):
        self.spark, self.versions, self.key = spark, Versions(spark, folder), key
        self.buckets, self.cell, self.fanout = buckets, cell, fanout

    def state(self, version: int | None = None) -> dict:
        """runs: name and number of values of each."""
        return self.versions.read(version) or {"runs": []}

    # --- Asking ---

    def new(self, values: DataFrame, state: dict | None = None) -> DataFrame:
        """The distinct values (key) that the set doesn't hold; null is none."""
        asked = self._keyed(values.filter(F.col(self.key).isNotNull()).select(self.key).distinct())
        return asked.join(self.held(asked, state).select(self.key), self.key, "left_anti").select(self.key)

    def held(self, values: DataFrame, state: dict | None = None) -> DataFrame:
        """The values (key) that the set holds."""
        state = self.state() if state is None else state
        if not state["runs"]:
            return self.spark.createDataFrame([], f"{self.key} STRING")
        asked = durable(self._keyed(values))
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
        found = None
        for run in state["runs"]:
            part = self._held_in(run["name"], asked, buckets)
            if part is not None:
                found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], f"{self.key} STRING") if found is None else found

    def _keyed(self, values: DataFrame) -> DataFrame:
        """The values with their bucket and two hashes."""
        v = F.col(self.key)
        return values.select(self.key, bucket_of(v, self.buckets).alias("bucket"), F.xxhash64(F.lit("seen"), v).alias("high"), F.xxhash64(v).alias("low"))

    def _held_in(self, run: str, asked: DataFrame, buckets: list[int]) -> DataFrame | None:
        """The asked values that a run holds; None if no cell may hold one."""
        filters = self.spark.read.schema(FILTERS).parquet(self.versions.at(run) + "/filters").filter(F.col("bucket").isin(buckets))
        cut = filters.select("bucket", "parts").distinct()
        asked = asked.join(F.broadcast(cut), "bucket").withColumn("part", F.pmod("high", "parts").cast("int")).drop("parts")

        def pass_filter(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return left.iloc[:0]
            cell = right.iloc[0]
            return left[may_hold(cell["bits"], left["high"].to_numpy(np.int64), left["low"].to_numpy(np.int64), int(cell["size"]))]

        may = durable(asked.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part")).applyInPandas(pass_filter, asked.schema))
        cells = may.select("bucket", "part").distinct().collect()
        if not cells:
            return None
        folder = self.versions.at(run) + "/cells"
        values = self.spark.read.schema(f"{self.key} STRING").parquet(*[f"{folder}/bucket={c['bucket']}/part={c['part']}" for c in cells])
        return may.select(self.key).join(values, self.key, "left_semi")

    # --- Adding ---

    def add(self, values: DataFrame) -> int:
        """Add distinct values that the set doesn't hold (as `new` gives them); gives the new version."""
        return self.commit(self.state(), self.write(values))

    def write(self, values: DataFrame) -> dict:
        """Write a run, which no version names yet."""
        name = self.versions.fresh("run")
        rows = durable(self._keyed(values.select(self.key)))
        # At most a row for each bucket.
        counts = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
        if not counts:
            return {"name": name, "n": 0}
        parts = self.spark.createDataFrame([(b, -(-n // self.cell)) for b, n in counts.items()], "bucket INT, parts INT")
        rows = rows.join(F.broadcast(parts), "bucket").withColumn("part", F.pmod("high", "parts").cast("int"))
        rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", self.key).select(self.key, "bucket", "part").write.partitionBy("bucket", "part").parquet(self.versions.at(name) + "/cells")

        def cell(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
            size = -(-len(batch) * BITS // 64) * 64
            return pd.DataFrame({"bucket": [key[0]], "part": [key[1]], "parts": [batch["parts"].iloc[0]], "n": [len(batch)], "size": [size], "bits": [filter_of(batch["high"].to_numpy(np.int64), batch["low"].to_numpy(np.int64), size)]})

        cells = rows.select("bucket", "part", "parts", "high", "low").groupBy("bucket", "part").applyInPandas(cell, FILTERS)
        cells.repartitionByRange("bucket").sortWithinPartitions("bucket", "part").write.parquet(self.versions.at(name) + "/filters")
        return {"name": name, "n": sum(counts.values())}

    def with_run(self, state: dict, run: dict) -> dict:
        """The state with a further run; runs of a size tier are merged when there are `fanout` of them."""
        runs = [*state["runs"], run] if run["n"] else list(state["runs"])
        while True:
            tiers: dict[int, list[dict]] = {}
            for r in runs:
                tiers.setdefault(int(math.log(max(r["n"], 1), self.fanout) + 1e-9), []).append(r)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if not full:
                return {"runs": runs}
            runs = [r for r in runs if r not in full] + [self.write(self.all({"runs": full}))]

    def commit(self, state: dict, run: dict) -> int:
        state = self.with_run(state, run)
        return self.versions.commit(self.versions.latest() + 1, state, [r["name"] for r in state["runs"]])

    def all(self, state: dict | None = None) -> DataFrame:
        """All values."""
        paths = [self.versions.at(r["name"]) + "/cells" for r in (self.state() if state is None else state)["runs"]]
        if not paths:
            return self.spark.createDataFrame([], f"{self.key} STRING")
        return self.spark.read.schema(f"{self.key} STRING").option("recursiveFileLookup", True).parquet(*paths)

    def vacuum(self, keep: int = 1) -> list[str]:
        return self.versions.vacuum(keep)


def false_share(n: int, size: int) -> float:
    """The share of other values that a filter of `size` bits with n values takes for its own, in expectation."""
    return (1 - math.exp(-HASHES * n / size)) ** HASHES
