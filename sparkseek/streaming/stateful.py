"""Streams with keyed state of their own: hosts' turns by timers, and joins of two streams by time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import origin

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turns(StatefulProcessor):
    """A host's next free turn, and its URLs whose turn has not come: each waits under its turn, with a timer of its own."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "turn LONG")
        self.pending = handle.getMapState("pending", "turn LONG", "url STRING, seq LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        turn = self.next.get()[0] if self.next.exists() else 0
        for row in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            if row["url"] is None:
                continue
            turn = max(turn, int(row["at"].timestamp() * 1000))
            self.pending.updateValue((turn,), (row["url"], row["seq"]))
            self.handle.registerTimer(turn)
            turn += self.delay
        self.next.update((turn,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        turn = expiredTimerInfo.getExpiryTimeInMs()
        if self.pending.containsKey((turn,)):
            url, seq = self.pending.getValue((turn,))
            self.pending.removeKey((turn,))
            yield Row(host=key[0], url=url, seq=seq, turn=turn)

    def close(self) -> None:
        pass


def host_turns(urls: DataFrame, delay: int = 1000, late: str = "0 seconds") -> DataFrame:
    """host, url, seq, turn (milliseconds) of a stream of url, seq, at (a timestamp): each URL when its turn has come.

    A host is asked once in `delay` milliseconds, in order of at and seq. A URL comes out when the watermark has passed
    its turn. A row without a URL moves the watermark on, and nothing else.
    """
    rows = urls.withWatermark("at", late).withColumn("host", F.coalesce(origin(F.col("url")), F.lit("")))
    return rows.groupBy("host").transformWithState(Turns(delay), "host STRING, url STRING, seq LONG, turn LONG", "append", "eventTime")


def turns_of(urls: DataFrame, delay: int = 1000) -> DataFrame:
    """The same of a table: a host's n-th URL has the greatest of the times of those before it, each with the delays since. A host is one task."""
    rows = urls.filter(F.col("url").isNotNull()).withColumn("host", F.coalesce(origin(F.col("url")), F.lit("")))
    order = Window.partitionBy("host").orderBy("at", "seq")
    n = F.row_number().over(order) * F.lit(delay)
    rows = rows.withColumn("_n", n).withColumn("_free", F.unix_millis("at") - F.col("_n"))
    return rows.withColumn("turn", F.max("_free").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")).select("host", "url", "seq", "turn")


def with_rocks_db(spark: SparkSession) -> str | None:
    """Set the state store that keyed state with timers needs; gives the setting before, for `spark.conf.set` or `unset`."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    return before


def followed_by(left: DataFrame, right: DataFrame, by: str, within: str = "30 minutes", late: str = "3 hours") -> DataFrame:
    """Each left row (by, at, id) with the right rows of its key up to `within` later; left rows with none when none can come.

    For streams both sides have a watermark, and the join keeps only rows that can still meet; for tables it is the plain join.
    """
    a = left.select(F.col(by).alias("key"), F.col("at").alias("left_at"), F.col("id").alias("left_id"))
    b = right.select(F.col(by).alias("_key"), F.col("at").alias("right_at"), F.col("id").alias("right_id"))
    if left.isStreaming:
        a, b = a.withWatermark("left_at", late), b.withWatermark("right_at", late)
    near = (F.col("key") == F.col("_key")) & (F.col("right_at") >= F.col("left_at")) & (F.col("right_at") <= F.col("left_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near, "left_outer").drop("_key")
