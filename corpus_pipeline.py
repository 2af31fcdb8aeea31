"""The corpus pipeline over `documents`: language, near-duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the
next stage's documents. Mixing decides an order and sharding a place, so the result carries the order as a column:
`mix_order` rises with the schedule, over all shards and within each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import decontaminate, language, mixing, order_minhash, sharding
from sparkseek.llm.common import shared_folder, table
from sparkseek.session import drop_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells."""
    return language.accepted(docs)


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return order_minhash.deduplicated(docs)


def leave_out_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, as runs of the Hilbert curve, and their place in the order of mixing."""
    return sharding.shard_documents(ordered(docs))


def ordered(docs: DataFrame) -> DataFrame:
    """The rows with mix_order: the number of the file and of the row in it, in place of a given column of that name.

    Rows that come from no file have their present order.
    """
    docs = docs.drop("mix_order")
    if not docs.inputFiles():
        return docs.withColumn("mix_order", F.monotonically_increasing_id())
    file = docs.metadataColumn("_metadata")
    part = F.try_to_number(F.regexp_extract(file["file_name"], r"^part-(\d+)", 1), F.lit("9" * 9)).cast("long")
    return docs.select("*", (F.shiftleft(F.coalesce(part, F.lit(0)), 40) + file["row_index"]).alias("mix_order"))


STAGES = [("language", known_language), ("near_dedup", first_of_near_duplicates), ("decontamination", leave_out_benchmark), ("mixing", mix_sources), ("sharding", shard)]
#: The language model of the first stage is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again; the last one's files stay."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            drop_folder(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
