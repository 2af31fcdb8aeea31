"""Dropping lines that many documents share, by a sharded minimal perfect hash over the distinct line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased, and a key is told by 128 bits of BLAKE2b.
Each document gives the hashes of its distinct keys of LEAST code points or more, which are counted by documents, with
the largest doc_id that holds them; keys of fewer than `floor` documents can't decide anything and go. The others are
dealt to shards of about SHARD_KEYS by their first bits. A shard's minimal perfect hash has levels: each key that has a bit of the level
to itself stands there, the others go to the next level, and a key's slot is the number of bits set before its own
(about 3.4 bits a key). Slots index three arrays: fingerprint (64 further bits), count and largest id (a null one is the least).

Documents probe the arrays, no line is joined. Arrays of up to BROADCAST_BYTES in all go to every task, and documents
are probed where they are read. Of larger ones, runs of shards within that bound are sent one after the other, and each
probes only its own keys, of which a narrow table (two halves of a key, doc_id) is written by run; a document gets back
the keys to drop by its id. So work stays linear, and a line that many documents hold is probed wherever its rows lie.
Both ways give the same rows. A key that is not in the arrays passes the fingerprint with a chance of 2**-64.

Edge cases: a null or empty text is one empty line; no text has no lines. Rows that repeat an id are documents of their
own, so the largest id may hold a line more than once; all lines in a document with the largest id stay, repeated ones too. A
null id is smaller than all others. Empty tables give no rows. Further columns are not looked at.
Ids are integers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import drop_folder
from .common import arrow_limits, drop_table, durable, shared_folder

LEAST, DOCUMENTS = 40, 5
SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARD_KEYS = 1 << 20
#: Bits of a level for each key that it gets.
ROOM = 2
#: Arrays of more bytes in all are not sent to every task.
BROADCAST_BYTES = 64 << 20
NO_ID = -(1 << 63)
ENTRY = np.dtype([("mark", "<u8"), ("count", "<u4"), ("last", "<i8")])
KEYS = "high LONG, low LONG, doc_id LONG"
SHARD = "shard LONG, bits BINARY, sizes ARRAY<LONG>, entries BINARY"


def key_of(line: str) -> str:
    return line.strip(SPACE).translate(LOWER)


def hashes(text: str | None, least: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A text's lines, the numbers of those with a key of `least` code points or more, and 128 bits of each such key."""
    lines = (text or "").split("\n")
    own = [(i, k) for i, k in ((i, key_of(x)) for i, x in enumerate(lines) if len(x) >= least) if len(k) >= least]
    digests = b"".join(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=16).digest() for _, k in own)
    return lines, np.array([i for i, _ in own], np.int64), np.frombuffer(digests, "<i8").reshape(-1, 2)


# --- The hash ---


def spots(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """A key's bit in a level of `size` bits."""
    x = high.view(np.uint64) ^ (low.view(np.uint64) * np.uint64(2 * level + 0x9E3779B97F4A7C15))
    for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(m)
    return (x ^ (x >> np.uint64(32))) % np.uint64(size)


def minimal_hash(high: np.ndarray, low: np.ndarray) -> tuple[bytes, list[int]]:
    """The bits of all levels, and the levels' sizes (whole words of 64 bits), for distinct keys."""
    bits, sizes, level = [], [], 0
    while len(high):
        size = -(-ROOM * len(high) // 64) * 64
        at = spots(high, low, level, size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        stay = ~alone[at]
        high, low, level = high[stay], low[stay], level + 1
    return np.packbits(np.concatenate([np.zeros(0, bool), *bits]), bitorder="little").tobytes(), sizes


class Table:
    """One shard's minimal perfect hash and its arrays."""

    def __init__(self, bits: bytes, sizes: list[int], entries: bytes):
        self.words, self.sizes = np.frombuffer(bits, "<u8"), list(sizes)
        number = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(number) - number
        self.entries = np.frombuffer(entries, ENTRY)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's slot; of other keys any slot, or -1."""
        out, left, base = np.full(len(high), -1), np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            at = spots(high[left], low[left], level, size) + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (self.words[word] >> bit & np.uint64(1)) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = (self.before[word] + np.bitwise_count(below))[here]
            left, base = left[~here], base + size
        return out

    def dropped(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray, documents: int) -> np.ndarray:
        """Which keys go from documents with these ids: those of enough documents, but for the largest id."""
        slot = self.slots(high, low)
        own = self.entries[slot] if len(self.entries) else np.zeros(len(slot), ENTRY)
        return (slot >= 0) & (own["mark"] == low.view(np.uint64)) & (own["count"] >= documents) & (own["last"] != ids)


def shard_of(high, shards: int):
    """The shard of a key, by its first bits; for arrays and columns."""
    return (high >> 32) % shards if isinstance(high, np.ndarray) else F.pmod(F.shiftright(high, 32), F.lit(shards))


def keys_of(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """high, low, doc_id: the distinct keys of every document."""
    arrow_limits(documents.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(hashes(t, least)[2], axis=0) for t in batch.column(1).to_pylist()]
            ids = np.repeat(ids_of(batch.column(0)), [len(x) for x in own])
            both = np.concatenate([np.zeros((0, 2), np.int64), *own])
            yield pa.RecordBatch.from_pydict({"high": both[:, 0], "low": both[:, 1], "doc_id": ids})

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(keys, KEYS)


def build(documents: DataFrame, least: int = LEAST, floor: int = DOCUMENTS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The shards (SHARD), written once, of the keys that `floor` documents or more hold, and into how many keys are dealt."""
    keys = keys_of(documents, least).groupBy("high", "low").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    keys = durable(keys.filter(F.col("n") >= floor))
    shards = max(1, -(-keys.count() // shard_keys))

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        high, low = (rows[c].to_numpy(np.int64) for c in ("high", "low"))
        bits, sizes = minimal_hash(high, low)
        entries = np.zeros(len(rows), ENTRY)
        slot = Table(bits, sizes, b"").slots(high, low)
        entries["mark"][slot], entries["count"][slot], entries["last"][slot] = low.view(np.uint64), np.minimum(rows["n"], (1 << 32) - 1), rows["last"]
        return pd.DataFrame({"shard": [int(rows["_shard"].iloc[0])], "bits": [bits], "sizes": [sizes], "entries": [entries.tobytes()]})

    out = durable(keys.withColumn("_shard", shard_of(F.col("high"), shards)).groupBy("_shard").applyInPandas(shard, SHARD))
    drop_table(keys)
    return out, shards


# --- Documents ---


def ids_of(column: pa.Array) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in column.to_pylist()], np.int64)


def lookup(spark: SparkSession, tables: DataFrame, shards: int, documents: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A function of high, low and doc_id that tells which keys go, by the arrays of these shards, which are sent to every task."""
    sent = spark.sparkContext.broadcast({r["shard"]: (bytes(r["bits"]), r["sizes"], bytes(r["entries"])) for r in tables.collect()})
    held: dict[int, Table] = {}

    def gone(high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out, own = np.zeros(len(high), bool), shard_of(high, shards)
        for n in np.unique(own):
            if int(n) not in held and int(n) in sent.value:
                held[int(n)] = Table(*sent.value[int(n)])
            if int(n) in held:
                at = np.flatnonzero(own == n)
                out[at] = held[int(n)].dropped(high[at], low[at], ids[at], documents)
        return out

    return gone


def stripped(rows: DataFrame, least: int, gone: Callable | None) -> DataFrame:
    """The rows with _lines, _dropped and _kept (the text left). Without `gone`, _gone has the keys that go: pairs in a row."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [hashes(t, least) for t in batch.column("text").to_pylist()]
            if gone:
                sizes = [len(x[1]) for x in own]
                keys = np.concatenate([np.zeros((0, 2), np.int64), *(x[2] for x in own)])
                out = gone(keys[:, 0].copy(), keys[:, 1].copy(), np.repeat(ids_of(batch.column("doc_id")), sizes))
                out = np.split(out, np.cumsum(sizes)[:-1])
            else:
                lists = [set(zip(x[::2], x[1::2], strict=True)) if x else () for x in batch.column("_gone").to_pylist()]
                out = [np.array([tuple(k) in x for k in o[2].tolist()], bool) for o, x in zip(own, lists, strict=True)]
            n, dropped, kept = [], [], []
            for (lines, at, _), which in zip(own, out, strict=True):
                drop = set(at[which].tolist())
                n.append(len(lines))
                dropped.append(len(drop))
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*batch.schema.names, "_lines", "_dropped", "_kept"])

    schema = StructType([*rows.schema.fields, StructField("_lines", LongType()), StructField("_dropped", LongType()), StructField("_kept", StringType())])
    return rows.mapInArrow(strip, schema)


def deduplicated(documents: DataFrame, least: int = LEAST, floor: int = DOCUMENTS, most: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, text, _lines, _dropped, _kept (the text left) of all documents (doc_id, text)."""
    spark = documents.sparkSession
    tables, shards = build(documents, least, floor, shard_keys)
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    bytes_of = F.octet_length("bits") + F.octet_length("entries")
    size, largest = tables.agg(F.coalesce(F.sum(bytes_of), F.lit(0)), F.max(bytes_of)).first()
    if size <= most:
        return stripped(rows, least, lookup(spark, tables, shards, floor))
    # Runs of shards that are sent at once, each with the keys that its pass reads.
    run = max(1, most // largest)
    keys = keys_of(documents, least).withColumn("_run", F.floor(shard_of(F.col("high"), shards) / run))
    folder = f"{shared_folder(spark)}/keys-{uuid.uuid4().hex}"
    keys.write.partitionBy("_run").parquet(folder)
    hits = None
    for n in range(-(-shards // run)):
        gone = lookup(spark, tables.filter(F.col("shard").between(n * run, n * run + run - 1)), shards, floor)
        part = durable(probed(spark.read.parquet(folder).filter(F.col("_run") == n).select("high", "low", "doc_id"), gone))
        hits = part if hits is None else hits.unionByName(part)
    drop_folder(spark, folder)
    # Equal keys of rows with one id are given once, so a document's list is no longer than its lines.
    lists = hits.distinct().groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("high", "low"))).alias("_gone"))
    known = rows.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    return stripped(known.join(lists.withColumnRenamed("doc_id", "_id"), "_id", "left").drop("_id"), least, None).drop("_gone")


def probed(keys: DataFrame, gone: Callable) -> DataFrame:
    """The keys that go."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = gone(*(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns))
            yield batch.filter(pa.array(out))

    return keys.mapInArrow(probe, KEYS)


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of what `deduplicated` gives."""
    return rows.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""
