"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With weight w, block i of a source is released at floor(i / w)
and due at ceil((i + 1) / w); the released block with the earliest deadline runs next. Weights are exact ratios of
whole numbers and add up to 1, so no deadline is missed, and every prefix of a phase, however long, holds each source's
due share, weight x slots, to less than one block.

No document is dropped or repeated. When a source has no blocks left, the others go on with their weights
scaled up (a new phase, in which releases and deadlines begin anew); there are as many phases as sources. Every source
is mixed by itself, however many there are. Phases and blocks follow each other, so one task plans them, a step for
each block. A block has BLOCK rows, or total / BLOCKS where that is more, so there are at most BLOCKS blocks and one for
each source: the plan is of bounded size and the deviation always below 1 / BLOCKS of all rows, or 32 rows. The driver
holds no sources.

A source's documents stand in the order of a hash of their ids. Counts and hash together tell about where a row
stands among all, which deals the rows to parts of about PART rows in that order; exact places are a row's number in
its part and the part's offset. So a source of any size is numbered by as many tasks as its rows fill.

Edge cases: a null source is a source of its own; sources without a given weight, and weights of 0 or less,
share what no other source claims (they follow in a last phase); weights that are no finite numbers are refused; texts
are not looked at; rows that repeat an id all get places; an empty table gives no rows; further columns stay as they
are. Ids are of any type that has a text.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_of
from .common import durable, small

#: Rows of a block, and the number of blocks beyond which blocks are larger.
BLOCK, BLOCKS = 32, 1 << 18
#: Rows that are numbered in one sort, about.
PART = 200_000
#: Default target weight of a source with n documents: n ** TEMPER, scaled.
TEMPER = 0.5
#: Blocks that the planning task gives at once, about.
GIVEN = 100_000


class Active:
    """The sources that are mixed, by number: of each weight, its sources in rising order."""

    def __init__(self, numbers: Iterable[int], weights: Iterable[float]):
        own: dict = {}
        for s, w in zip(numbers, weights, strict=True):
            own.setdefault(float(w), array("q")).append(s)
        self.values = sorted(own)
        self.own = [own[w] for w in self.values]
        self.first = np.zeros(len(own), np.int64)
        self.n = np.array([len(x) for x in self.own], np.int64)
        self.count = int(self.n.sum())
        # The sum of weights stays exact while sources leave.
        ratios = [w.as_integer_ratio() for w in self.values]
        unit = max((d for _, d in ratios), default=1)
        self.whole = [x * (unit // d) for x, d in ratios]
        self.total = sum(x * len(s) for x, s in zip(self.whole, self.own, strict=True))

    def remove(self, s: int, weight: float) -> None:
        """Close the gap from the nearer end; sources that end are mostly the first of their weight."""
        k = bisect_left(self.values, weight)
        own, lo, hi = self.own[k], int(self.first[k]), int(self.first[k] + self.n[k])
        i = bisect_left(own, s, lo, hi)
        if i - lo < hi - i:
            own[lo + 1 : i + 1] = own[lo:i]
            self.first[k] += 1
        else:
            own[i : hi - 1] = own[i + 1 : hi]
        self.n[k] -= 1
        self.count -= 1
        self.total -= self.whole[k]
        if not self.n[k]:
            del self.values[k], self.own[k], self.whole[k]
            self.first, self.n = np.delete(self.first, k), np.delete(self.n, k)

    def groups(self) -> Iterator[tuple[int, array, int, int]]:
        """The larger weights first, as whole numbers, each with its sources: those of `own` from start to end."""
        for k in reversed(range(len(self.values))):
            yield self.whole[k], self.own[k], int(self.first[k]), int(self.first[k] + self.n[k])


def slots_of(groups: Iterator[tuple[int, array, int, int]], total: int, left: array) -> dict[int, list[int]]:
    """The slots that each source gets until one has none of its `left` blocks left: earliest deadline first among the released.

    A source's weight is its whole number over `total`. Of sources that haven't run, only the next one of each weight
    that could run is looked at.
    """
    ready: list = []
    waiting: list = []
    slots: dict = {}
    group = next(groups, None)
    for slot in count():
        while waiting and waiting[0][0] <= slot:
            _, s, i, whole = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // whole), s, i, whole, None))
        while group and (not ready or -(-total // group[0]) <= ready[0][0]):
            whole, own, start, end = group
            heapq.heappush(ready, (-(-total // whole), own[start], 0, whole, (own, start + 1, end)))
            group = next(groups, None)
        due, s, i, whole, others = heapq.heappop(ready)
        if due < slot + 1:
            raise ValueError("a deadline was missed")
        if others and others[1] < others[2]:
            own, start, end = others
            heapq.heappush(ready, (due, own[start], 0, whole, (own, start + 1, end)))
        slots.setdefault(s, []).append(slot)
        if i + 1 == left[s]:
            return slots
        heapq.heappush(waiting, ((i + 1) * total // whole, s, i + 1, whole))


def runs(blocks: Iterable[int], weights: Iterable[float]) -> Iterator[tuple[int, int, int, list[int]]]:
    """Source, its first block of a phase, the phase's first slot, slots in it; sources are numbered by the order of names."""
    left, weights = array("q", blocks), array("d", weights)
    done, base = array("q", bytes(8 * len(left))), 0
    for given in (True, False):
        weight = (lambda s: weights[s]) if given else (lambda s: 1.0)
        numbers = array("q", (s for s, n in enumerate(left) if n and (weights[s] > 0) == given))
        active = Active(numbers, map(weight, numbers))
        while active.count:
            slots, last = slots_of(active.groups(), active.total, left), 0
            for s, own in slots.items():
                yield s, done[s], base, own
                done[s] += len(own)
                left[s] -= len(own)
                last = max(last, own[-1] + 1)
                if not left[s]:
                    active.remove(s, weight(s))
            base += last


def by_order(name: object) -> tuple[str, bool]:
    """Names' order, which settles ties; a null source stands right before one that is named None."""
    return str(name), name is not None


def phases(blocks: dict, weights: dict) -> list[dict]:
    """Rows s (source), first (its first block), base (the phase's first slot), slots (in the phase)."""
    names = sorted(blocks, key=by_order)
    found = runs((blocks[s] for s in names), (weights.get(s, 0) for s in names))
    return [{"s": names[s], "first": first, "base": base, "slots": own} for s, first, base, own in found]


def sources(docs: DataFrame, weights: dict | None) -> DataFrame:
    """_name (the source), g (its number in the order of names), start and n (its first row in the order of all, and its
    rows), weight (null: by n). One narrow row a source, numbered by one task.
    """
    names = docs.groupBy(F.col("source").cast("string").alias("_name")).agg(F.count("*").alias("n"))
    # Names' order is that of by_order.
    order = Window.orderBy(F.coalesce("_name", F.lit("None")), F.col("_name").isNotNull())
    start = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = names.select("_name", (F.row_number().over(order) - 1).alias("g"), start.alias("start"), "n")
    if not weights:
        return durable(names.withColumn("weight", F.lit(None).cast("double")))
    if not all(math.isfinite(w) for w in weights.values()):
        raise ValueError(f"weights are finite numbers: {weights}")
    given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, weight double")
    return durable(names.join(small(given), F.col("_name").eqNullSafe(F.col("s")), "left").drop("s").fillna(0.0, "weight"))


def planned(names: DataFrame, block: int) -> DataFrame:
    """s (the source's number), b, slot: every block and its slot."""

    def by_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, weights = array("q"), array("d")
        for batch in batches:
            own = batch["n"].to_numpy(np.int64)
            value, which = np.unique(own, return_inverse=True)
            by_size = np.array([int(x) ** TEMPER for x in value])[which]
            weight = batch["weight"].to_numpy(np.float64)
            n.frombytes((-(-own // block)).tobytes())
            weights.frombytes(np.where(np.isnan(weight), by_size, weight).tobytes())
        rows, size = [], 0
        for run in runs(n, weights):
            rows.append(run)
            size += len(run[-1])
            if size >= GIVEN:
                yield blocks_of(rows)
                rows, size = [], 0
        if rows:
            yield blocks_of(rows)

    return durable(names.select("g", "n", "weight").coalesce(1).sortWithinPartitions("g").mapInPandas(by_block, "s long, b long, slot long"))


def blocks_of(rows: list[tuple[int, int, int, list[int]]]) -> pd.DataFrame:
    """Runs as rows s, b, slot."""
    parts = [(np.full(len(own), s), first + np.arange(len(own)), base + np.array(own)) for s, first, base, own in rows]
    return pd.DataFrame(dict(zip(("s", "b", "slot"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)))


def scheduled(docs: DataFrame, weights: dict | None, block: int | None) -> tuple[DataFrame, int]:
    """The rows of `schedule`, and the number of slots."""
    spark = docs.sparkSession
    names = sources(docs, weights)
    total = names.agg(F.sum("n")).first()[0] or 0
    block = block or max(BLOCK, -(-total // BLOCKS))
    slots = names.agg(F.sum(F.floor((F.col("n") + block - 1) / block))).first()[0] or 0
    plan = planned(names, block)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART)
    spread = F.xxhash64(F.col("doc_id").cast("string"), F.lit("order"))
    names = small(names.drop("weight"))

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("spread", spread).join(names, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
        about = F.col("start") + (F.col("spread") / F.lit(2.0**64) + 0.5) * F.col("n")
        return rows.withColumn("part", share_of(about, total, parts))

    counts = dealt(docs.select("doc_id", F.col("source").cast("string").alias("source"))).groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("part").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    # Rows of one id are told apart by all columns that can be hashed, so that a part run again has the same order.
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))])
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.col("source").cast("string").alias("source"), whole.alias("whole"))
    within = Window.partitionBy("part").orderBy("start", "spread", "doc_id", "whole")
    # One row for each part.
    rows = dealt(rows).withColumn("nth", F.row_number().over(within)).join(F.broadcast(offsets), F.col("part") == F.col("p"))
    index = F.col("before") + F.col("nth") - 1 - F.col("start")
    rows = rows.select("row", "g", F.floor(index / block).alias("block"), (index % block).cast("int").alias("place"))
    rows = rows.join(small_of(plan, slots), (F.col("g") == F.col("s")) & (F.col("block") == F.col("b")))
    return rows.select("row", "block", "place", "slot"), slots


def schedule(docs: DataFrame, weights: dict | None = None, block: int | None = None) -> DataFrame:
    """row (the whole given row), block (its number in the source), place (in the block), slot (of the block)."""
    return scheduled(docs, weights, block)[0]


def share_of(place: Column, total: int, parts: int) -> Column:
    """The part of a place when `total` places are dealt to equal parts in order."""
    return F.least(F.floor(place * (parts / max(total, 1))), F.lit(parts - 1)).cast("int")


def mixed(docs: DataFrame, weights: dict | None = None, block: int | None = None) -> DataFrame:
    """The documents in the order of the schedule: files and rows within them follow it."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out, slots = scheduled(docs, weights, block)
    # Slots are dense, so that equal shares of them are equal shares of the rows, but for sources' last blocks.
    return out.repartitionById(parts, share_of(F.col("slot"), slots, parts)).sortWithinPartitions("slot", "place").select("row.*")
