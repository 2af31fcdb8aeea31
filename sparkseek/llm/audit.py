"""What each of five filters removes, in each order of applying them, by a product of an incidence matrix.

A document fails a set of filters, its mask of 32 possible ones. Masks are counted by part: all documents, those of good
quality, and toxic ones, 32 counts a row. For all 120 orders and 5 steps, 600 columns, an incidence matrix of 32 x 600
says which masks a step keeps, removes, finds removed already (redundant), or which fail its filter alone (unique). A
part's outcomes are its counts times these matrices, in whole numbers; so documents are read once, whatever the orders,
and only 32 counts a part leave the tasks.

Filters: A: fewer than 200 words; B: less than half of the words distinct; C: more than 3 % capitals (A-Z); D: one of #$%&*|;
E: the text of a document with a smaller doc_id. Equal texts are told by SHA-256. Every document but the first of its text
fails E, so each counts as failing at first, and one narrow row a text, its first document, is moved to the mask without
E: no join of documents with documents, and copies are combined before the shuffle, however many there are. Texts are
read once, into narrow rows that are written.

Edge cases: a null text is empty, a null lang is the part ''; rows that repeat an id don't fail E by each other; a
null id is smaller than all others; several labels of an id count once, and a label that is null doesn't count; empty tables
give no rows. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

FILTERS = "ABCDE"
#: Characters between words.
GAP = r"[ \t-\r]+"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
#: Of good quality, toxic: what their counts are called where a step removes them.
LABELS = {"good": "good_lost", "toxic": "toxic_lost"}
RESULT = "part STRING, filter_order STRING, step INT, " + ", ".join(f"{c} LONG" for c in (*OUTCOMES, *LABELS.values(), "shapley"))


def matrices() -> dict[str, np.ndarray]:
    """Of each outcome a matrix of masks x (order, step), and shapley: masks x (order, step), how many orders remove a mask by its filter."""
    mask = np.arange(MASKS)[:, None]
    out = {name: np.zeros((MASKS, len(ORDERS) * len(FILTERS)), np.int64) for name in OUTCOMES}
    own = np.array([1 << FILTERS.index(c) for order in ORDERS for c in order])
    before = np.array([sum(1 << FILTERS.index(c) for c in order[:i]) for order in ORDERS for i in range(len(order))])
    out["kept"][:] = (mask & (before | own)) == 0
    out["removed"][:] = ((mask & own) > 0) & ((mask & before) == 0)
    out["redundant"][:] = ((mask & own) > 0) & ((mask & before) > 0)
    out["unique_fails"][:] = mask == own
    by_filter = np.stack([out["removed"][:, own == 1 << i].sum(1) for i in range(len(FILTERS))], 1)
    return out | {"shapley": by_filter[:, np.log2(own).astype(int)]}


def failures(text: Column) -> Column:
    """The mask of the filters that look at the text alone."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    fails = (n < 200, 100 * distinct.cast("long") < 50 * n, 100 * capitals.cast("long") > 3 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def masked(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents have a mask, of good quality, toxic. Masks hold E for all but the first of a text."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = rows.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    # Rows of one id and text are counted before they meet the text's others; a text's first id has few kinds of them.
    kinds = durable(rows.groupBy("hash", "id", "part", "mask", "good", "toxic").agg(F.count("*").alias("n")))
    of_id = kinds.groupBy("hash", "id").agg(F.collect_list(F.struct("part", "mask", "good", "toxic", "n")).alias("rows"))
    by_id = F.struct(F.col("id").isNotNull(), "id")
    sums = lambda t, sign: t.groupBy("part", "mask", "good", "toxic").agg(F.sum(F.col("n") * sign).alias("n"))
    first = of_id.groupBy("hash").agg(F.min_by("rows", by_id).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    e = 1 << FILTERS.index("E")
    moved = sums(first, 1).unionByName(sums(first.withColumn("mask", F.col("mask") + e), -1))
    all_fail = sums(kinds.withColumn("mask", F.col("mask") + e), 1)
    counts = all_fail.unionByName(moved).groupBy("part", "mask")
    return counts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audited(masks: DataFrame) -> DataFrame:
    """RESULT of masks (part, mask, n, good, toxic): 600 rows for each part."""
    stacks = [F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows")]

    def outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = matrices()
        orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        for batch in batches:
            for part, rows in zip(batch["part"], batch["rows"], strict=True):
                counts = {name: np.zeros(MASKS, np.int64) for name in ("n", *LABELS)}
                for r in rows:
                    for name, own in counts.items():
                        own[r["mask"]] += r[name]
                out = {name: counts["n"] @ by[name] for name in (*OUTCOMES, "shapley")}
                lost = {c: counts[name] @ by["removed"] for name, c in LABELS.items()}
                yield pd.DataFrame({"part": part, "filter_order": orders, "step": steps, **out, **lost})

    return masks.groupBy("part").agg(*stacks).mapInPandas(outcomes, RESULT)


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """RESULT of documents (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    return audited(masked(documents, labels))


ORACLE_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
y AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(words) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INTEGER)
 + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(doc_id > first AS INTEGER) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN y USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
o AS (SELECT '' AS filter_order, 0 AS step UNION ALL SELECT filter_order || c, step + 1 FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE step < 5 AND NOT contains(filter_order, c)),
s AS (SELECT filter_order, step, 1 << CAST(ascii(substr(filter_order, step, 1)) - 65 AS INTEGER) AS own, coalesce(list_sum([1 << CAST(ascii(x) - 65 AS INTEGER) FOR x IN string_split(substr(filter_order, 1, step - 1), '') IF x <> '']), 0) AS past
 FROM (SELECT filter_order FROM o WHERE step = 5), (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (mask & own = 0 AND mask & past = 0) AS kept, sum(n) FILTER (mask & own > 0 AND mask & past = 0) AS removed, sum(n) FILTER (mask & own > 0 AND mask & past > 0) AS redundant,
 sum(n) FILTER (mask = own) AS unique_fails, sum(good) FILTER (mask & own > 0 AND mask & past = 0) AS good_lost, sum(toxic) FILTER (mask & own > 0 AND mask & past = 0) AS toxic_lost FROM h, (SELECT filter_order, step, own, CAST(past AS BIGINT) AS past FROM s) GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
