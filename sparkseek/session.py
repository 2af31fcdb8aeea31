"""Session settings and materialised tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table is broadcast only up to this many narrow rows (about 16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows that a task sorts or gathers, about, where the number of partitions is set by the rows.
TASK_ROWS = 1_000_000
#: Python sees at most so many rows and bytes of a partition at once.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def session(name: str = "sparkseek", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster, spark-submit's settings win over these."""
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]")
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; under a local master a temporary one where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def arrow_limits(spark: SparkSession) -> None:
    """Bound the batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def partitions_for(spark: SparkSession, rows: int) -> int:
    """A number of partitions that grows with the rows, so that a task's memory doesn't."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the table as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that `durable` wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("table-"):
            drop_folder(df.sparkSession, folder)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the (materialised) table is within BROADCAST_ROWS, else the table as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def small_of(df: DataFrame, n: int) -> DataFrame:
    """The same for a table whose number of rows is known."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def placed(df: DataFrame, *key: str, name: str = "_rank") -> DataFrame:
    """The rows with their place from 0 in the order of `key`, dense, as `name`.

    The range-sorted rows are written once, with the partition and the row in it; counts and places both come from
    that table, so nothing depends on how a plan is partitioned when it is run again. The offsets are one row for
    each partition.
    """
    rows = durable(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(counts), "_part").withColumn(name, place).drop("_part", "_at", "_before")
