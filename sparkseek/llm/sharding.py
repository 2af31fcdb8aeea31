"""Sharding by a Hilbert curve over quantised metadata (DataFrame functions only).

Several metadata dimensions are quantised to a few bits each, every cell of that grid gets its place on a
Hilbert curve, documents are ordered by (place, text checksum, doc_id), and the order is cut into runs. Law
`rows`: the counts of any two shards differ by one at most. Neighbouring cells share files, so the min/max
figures of a file prune on each of the dimensions, and copies of a text with equal metadata stand side by side.

Edge cases: a null text has size 1, checksum 0 and length class 0; null sources and languages are a value of
their own; rows of an equal key are told apart by their place in the sorted partition, so repeated rows all
stay; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, placed

SHARDS = 16
BITS = 4


@lru_cache
def hilbert(dims: int, bits: int) -> tuple[int, ...]:
    """Place on the curve of every cell; the cell number has the first dimension in its highest bits."""
    places = []
    for cell in range(1 << dims * bits):
        x = [cell >> bits * (dims - 1 - i) & (1 << bits) - 1 for i in range(dims)]
        for level in range(bits - 1, 0, -1):
            low = (1 << level) - 1
            for i in range(dims):
                if x[i] >> level & 1:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[i]) & low
                    x[0] ^= swap
                    x[i] ^= swap
        for i in range(1, dims):
            x[i] ^= x[i - 1]
        flip = 0
        for level in range(bits - 1, 0, -1):
            if x[-1] >> level & 1:
                flip ^= (1 << level) - 1
        place = 0
        for level in range(bits - 1, -1, -1):
            for v in x:
                place = place << 1 | (v ^ flip) >> level & 1
        places.append(place)
    return tuple(places)


def first_names(docs: DataFrame, columns: tuple[str, ...], bits: int) -> dict[str, list[tuple[str, int]]]:
    """Of each column the first name of every level, with the level: the name's rank among all, scaled to `bits` bits.

    All names are ranked in one sorted table; the driver gets at most a name for each level.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("name")) for c in columns]))
    names = placed(docs.select(each.alias("n")).select("n.*").filter("name IS NOT NULL").distinct(), "column", "name")
    sizes = names.groupBy("column").agg(F.min("_rank").alias("least"), F.count("*").alias("size"))
    level = F.floor((F.col("_rank") - F.col("least") + 1) * ((1 << bits) - 1) / F.col("size")).cast("int")
    found = names.join(F.broadcast(sizes), "column").groupBy("column", level.alias("level")).agg(F.min("name").alias("name")).collect()
    return {c: sorted((r["name"], r["level"]) for r in found if r["column"] == c) for c in columns}


def quantised_name(column: str, firsts: list[tuple[str, int]]) -> Column:
    """The level of a name; 0 for null."""
    level = F.lit(0)
    for name, at in sorted(firsts, key=lambda f: f[1]):
        level = F.when(F.col(column).cast("string") >= F.lit(name), at).otherwise(level)
    return level


def quantised_size(size: Column, bits: int) -> Column:
    """Half octaves of a size (the bits of its square), from 16 up, held to `bits` bits."""
    square = (size.cast("long") + 1) * (size.cast("long") + 1)
    return F.least(F.greatest(F.length(F.bin(square)) - 9, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def keyed(docs: DataFrame, bits: int = BITS, firsts: dict | None = None) -> DataFrame:
    """The whole rows as _row, doc_id, the sort key _place, _crc, _id and the size _size; firsts: of `first_names`."""
    cell, firsts = F.lit(0), first_names(docs, ("source", "lang"), bits) if firsts is None else firsts
    for part in (quantised_name("source", firsts["source"]), quantised_name("lang", firsts["lang"]), quantised_size(F.coalesce(F.length("text"), F.lit(0)), bits)):
        cell = F.shiftleft(cell, bits) + part
    curve = F.split(F.lit(",".join(map(str, hilbert(3, bits)))), ",").cast("array<int>")
    return docs.select(
        F.struct("*").alias("_row"),
        "doc_id",
        F.get(curve, cell).alias("_place"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_crc"),
        F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("_size"),
    )


def ranked(docs: DataFrame, firsts: dict | None = None) -> DataFrame:
    """One narrow row per document with its global rank.

    Texts are read once for the narrow rows, which are written, range-sorted and numbered; no window or task ever
    holds more than a range of the order.
    """
    key = ["_place", "_crc", "_id"]
    rows = durable(keyed(docs, firsts=firsts).select("doc_id", *key, "_size"))
    return placed(rows, *key).crossJoin(F.broadcast(rows.agg(F.count("*").alias("_total"))))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; also the place on the curve."""
    rows = ranked(docs)
    shard = F.expr(f"cast((_rank * {shards}) div _total as int)")
    return rows.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        shard.alias("shard"),
        F.expr(f"_rank - (((_rank * {shards}) div _total) * _total + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_place").alias("place"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with shard and place (given columns of these names are replaced), laid out as runs of the curve.

    Only the first key of each shard (at most `shards` rows) comes to the driver; the texts are then dealt
    by range once. Rows that repeat a key wholly stay together, on the later side of a cut.
    """
    firsts = first_names(docs, ("source", "lang"), BITS)
    rows = ranked(docs, firsts)
    shard = F.expr(f"cast((_rank * {shards}) div _total as int)")
    cuts = rows.groupBy(shard.alias("shard")).agg(F.min(F.struct("_place", "_crc", "_id")).alias("cut")).orderBy("shard").collect()
    own = F.lit(0)
    for row in cuts:
        if row["shard"]:
            c = row["cut"]
            later = (F.col("_place") > c["_place"]) | (F.col("_place") == c["_place"]) & ((F.col("_crc") > c["_crc"]) | (F.col("_crc") == c["_crc"]) & (F.col("_id") >= c["_id"]))
            own = F.when(later, row["shard"]).otherwise(own)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    out = keyed(docs, firsts=firsts).withColumn("_shard", own.cast("int")).repartitionByRange(parts, "_shard", "_place", "_crc", "_id").sortWithinPartitions("_shard", "_place", "_crc", "_id")
    given = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "place")]
    return out.select(*given, F.col("_shard").alias("shard"), F.col("_place").alias("place"))


def _crc_table() -> list[int]:
    """Fixed values by their rule: the reflected polynomial's remainder of each byte."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def _level_sql(column: str) -> str:
    return f"(SELECT CAST({column} AS VARCHAR) AS {column}, CAST(floor(row_number() OVER (ORDER BY CAST({column} AS VARCHAR)) * {(1 << BITS) - 1} / count(*) OVER ()) AS INTEGER) AS level FROM (SELECT DISTINCT {column} FROM documents WHERE {column} IS NOT NULL))"


ORACLE_SQL = f"""WITH k AS (SELECT {_crc_table()}::BIGINT[] AS crc, {list(hilbert(3, BITS))}::INTEGER[] AS curve),
b AS (SELECT doc_id, source, lang, coalesce(length(text), 0) AS chars, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
p AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) AS text_crc32,
curve[1 + coalesce(s.level, 0) * {1 << 2 * BITS} + coalesce(l.level, 0) * {1 << BITS} + least(greatest(length(bin(CAST(chars + 1 AS BIGINT) * (chars + 1))) - 9, 0), {(1 << BITS) - 1})] AS place
FROM b CROSS JOIN k LEFT JOIN {_level_sql("source")} s ON s.source = b.source LEFT JOIN {_level_sql("lang")} l ON l.lang = b.lang),
r AS (SELECT *, row_number() OVER (ORDER BY place, text_crc32, doc_id NULLS FIRST) - 1 AS rank, count(*) OVER () AS total FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(rank * {SHARDS} // total AS INTEGER) AS shard, CAST(rank - (rank * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot,
CAST(NULL AS INTEGER) AS grown_shard, place FROM r"""
