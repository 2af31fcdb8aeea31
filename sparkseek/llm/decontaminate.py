"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

A text's shingles are its runs of five words (letters and digits of the lower-cased text); a text of one to
four words has one shingle, all of it. An item is found in a document when the document holds at least 0.8 of
the item's distinct shingles.

Items are partitioned by size, in octaves of their number of shingles. The MinHash sketch of an item is the k
smallest hashes of its n shingles, k = n - need + EXTRA with need = ceil(0.8 n): a document that holds
`need` of the shingles holds at least EXTRA of those k, so the search has no false dismissals. A document's
sketch is every shingle hash up to the largest that a partition's items use, so it follows the document's
length, and a document is searched only for the partitions whose items fit into it. Candidates that share
EXTRA sketch hashes are verified by comparing the shingles themselves.

Edge cases: null, empty and wordless texts and items match nothing; repeated rows of a doc_id or item_id
count as one and give the largest containment; a null doc_id can match like any other; an empty table on
either side gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, small

WORDS, LEAST, EXTRA = 5, 0.8, 2
#: Items' shingles are broadcast up to so many characters; beyond that the pairs are shuffled to them.
BROADCAST_CHARS = 32 << 20
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_BREAK), lambda x: x != "")


def shingles(column: str, width: int, of) -> Column:
    """of(words) for each run of `width` words; for all words together where there are fewer."""
    w = F.col(column)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: of([F.get(w, i + j) for j in range(width)]))
    return F.when(F.size(w) >= width, runs).when(F.size(w) > 0, F.array(of([F.array_join(w, " ")]))).otherwise(F.array().cast("array<string>" if of is _text else "array<long>"))


def _text(run: list[Column]) -> Column:
    return F.concat_ws(" ", *run)


def _hash(run: list[Column]) -> Column:
    return F.xxhash64(*run)


def containment(docs: DataFrame, items: DataFrame, least: float = LEAST, width: int = WORDS) -> DataFrame:
    """doc_id, item_id, n_shingles, containment for each pair at or above `least`."""
    items = items.select("item_id", words("text").alias("_w")).select("item_id", F.array_distinct(shingles("_w", width, _text)).alias("_text"), F.array_sort(F.array_distinct(shingles("_w", width, _hash))).alias("_hash"))
    n = F.size("_text")
    items = items.filter(n > 0).withColumns({"_n": n, "_need": F.ceil(n * F.lit(least) - 1e-9).cast("int"), "_class": F.floor(F.log2(n)).cast("int")})
    items = items.withColumn("_k", F.least(n, n - F.col("_need") + EXTRA)).withColumn("_sketch", F.slice("_hash", 1, F.col("_k")))
    items = durable(items)
    # At most one row for each octave of sizes.
    classes = items.groupBy("_class").agg(F.max(F.element_at("_sketch", -1)).alias("top"), F.min("_need").alias("fits")).orderBy("_class").collect()
    if not classes:
        return docs.select("doc_id", F.lit(0).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("n_shingles"), F.lit(0.0).alias("containment")).limit(0)
    split = docs.select("doc_id", words("text").alias("_w"))
    hashed = split.select("doc_id", shingles("_w", width, _hash).alias("_h"))
    size = F.size("_h")
    top = F.greatest(F.lit(-(1 << 63)), *[F.when(size >= c["fits"], F.lit(c["top"])) for c in classes])
    sketched = hashed.withColumn("_top", top).select("doc_id", F.explode(F.array_distinct(F.filter("_h", lambda x: x <= F.col("_top")))).alias("_x"))
    probes = durable(items.select("item_id", "_k", "_need", "_n", F.explode("_sketch").alias("_x")))
    shared = sketched.join(small(probes), "_x").groupBy("doc_id", "item_id").agg(F.count("*").alias("_shared"), F.max(F.col("_k") - F.col("_n") + F.col("_need")).alias("_least"))
    found = durable(shared.filter(F.col("_shared") >= F.col("_least")).select(F.col("doc_id").alias("_doc"), "item_id"))
    # Only documents with a candidate are split a second time.
    texts = docs.select("doc_id", "text").join(small(found.select("_doc").distinct()), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    texts = texts.select("doc_id", words("text").alias("_w")).select("doc_id", F.array_distinct(shingles("_w", width, _text)).alias("_held"))
    wanted = items.select(F.col("item_id").alias("_item"), "_text", "_n", "_need")
    chars = wanted.agg(F.sum(F.aggregate("_text", F.lit(0).cast("long"), lambda total, t: total + F.length(t) + 16))).first()[0]
    pairs = texts.join(small(found), F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc").join(F.broadcast(wanted) if chars <= BROADCAST_CHARS else wanted, F.col("item_id").eqNullSafe(F.col("_item")))
    pairs = pairs.select("doc_id", "item_id", F.col("_n").alias("n_shingles"), F.size(F.array_intersect("_text", "_held")).alias("_common"), "_need")
    return pairs.filter(F.col("_common") >= F.col("_need")).groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max(F.col("_common") / F.col("n_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, width: int = WORDS) -> DataFrame:
    """The documents that hold no item; all columns stay. Rows that repeat a doc_id go together."""
    hit = durable(containment(docs, items, least, width).select(F.col("doc_id").alias("_hit")).distinct())
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"))
    return rows.join(small(hit), F.col("_doc").eqNullSafe(F.col("_hit")), "left_anti").select("_row.*")


ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{WORD_BREAK}'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
v AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{WORD_BREAK}'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM v),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT d.doc_id, q.item_id, CAST(n.n AS INTEGER) AS n_shingles, count(*) / n.n AS containment
FROM d JOIN q USING (s) JOIN n ON n.item_id = q.item_id
GROUP BY d.doc_id, q.item_id, n.n HAVING count(*) >= ceil({LEAST} * n.n - 1e-9)
"""
