"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, durable

ROUNDS = 60


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each partition's edges only a forest that joins the same nodes: at most one edge a node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch["_a"].tolist(), batch["_b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in parent if (r := root(x)) != x]
    for i in range(0, len(rows), 50_000):
        yield pd.DataFrame(rows[i : i + 50_000], columns=["_a", "_b"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node that links reach), for every node of an edge. Self links are left out.

    Each partition first keeps a spanning forest of its edges, so a dense group costs its nodes, not its
    pairs. Then each round hangs larger neighbours on a node's smallest one (large star) and smaller ones
    likewise (small star) until all edges are stars. A hub's edges meet its minimum in an equi-join whose
    large partitions can be split. Every round ends in a written table.
    """
    e = edges.select(F.greatest(a, b).alias("_a"), F.least(a, b).alias("_b")).filter(F.col("_a") != F.col("_b"))
    e = durable(e.mapInPandas(_forest, "_a long, _b long").distinct())
    state, last = None, e
    for _ in range(ROUNDS):
        sides = e.unionByName(e.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = sides.groupBy("_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_m"))
        e = sides.join(least, "_a").filter(F.col("_b") > F.col("_a")).select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).filter(F.col("_a") != F.col("_b")).distinct()
        least = e.groupBy("_a").agg(F.min("_b").alias("_m"))
        e = e.join(least, "_a")
        e = e.select(F.explode(F.array(F.struct(F.col("_a").alias("x"), F.col("_m").alias("y")), F.struct(F.col("_b").alias("x"), F.col("_m").alias("y")))).alias("e"))
        old, e = last, durable(e.select(F.col("e.x").alias("_a"), F.col("e.y").alias("_b")).filter(F.col("_a") != F.col("_b")).distinct())
        drop_table(old)
        last = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("_a").alias("node"), F.col("_b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
