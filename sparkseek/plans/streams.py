"""Queries that run as streams over several batches of files, are stopped and started again, and equal one query over all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.temporal import asof_join, overlap_totals
from ..session import shared_folder
from ..streaming import stateful
from ..streaming.ingest import sessions

FAR, DAY = "2100-01-01 00:00:00", 86_400
#: Length of a batch of events, and how late half of its last rows come.
BATCH, LATE = 8 * DAY, 2 * 3_600


def _streamed(spark: SparkSession, batches: list[DataFrame], run) -> DataFrame:
    """The output of a stream over batches, each one file, in order: half of them, a stop, and the rest by the same checkpoint.

    The last two batches have one late time: the first moves the watermark on, the second lets all rows before it out.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    half = len(batches) // 2
    for part in (batches[:half], batches[half:]):
        for batch in part:
            batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = run(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _with_store(spark: SparkSession, run) -> DataFrame:
    before = stateful.with_rocks_db(spark)
    try:
        return run()
    finally:
        spark.conf.set(stateful.STATE_STORE, before) if before else spark.conf.unset(stateful.STATE_STORE)


def host_turn_stream(spark, sf_dir):
    """When each page's turn comes if ten pages arrive a second and a host is asked every two seconds, by keyed state and timers."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.col("page_id").alias("seq"), F.timestamp_seconds(DAY + F.floor(F.col("page_id") / 10)).alias("at"))
    n = rows.agg(F.max("seq")).first()[0] + 1
    batches = [rows.filter(F.floor(F.col("seq") * 4 / n) == i) for i in range(4)]
    end = spark.sql(f"SELECT CAST(NULL AS STRING) AS url, CAST(-1 AS BIGINT) AS seq, TIMESTAMP'{FAR}' AS at")
    found = _with_store(spark, lambda: _streamed(spark, [*batches, end, end], lambda stream: stateful.host_turns(stream, 2000, "2 seconds")))
    return found.select("seq", "url", "turn")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def purchases_after_clicks(spark, sf_dir):
    """Each click with its user's purchases in the 30 minutes after it, or -1, by a join of two streams; late rows are in."""
    rows = _events(spark, sf_dir).select("user_id", "at", F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    seconds = F.col("at").cast("long")
    first = F.lit(rows.agg(F.min(seconds)).first()[0])
    # Every other row of a batch's last two hours comes with the next batch.
    late = ((seconds - first) % BATCH >= BATCH - LATE) & (F.col("id") % 2 == 0)
    dealt = rows.withColumn("n", F.floor((seconds - first) / BATCH) + late.cast("int"))
    last = dealt.agg(F.max("n")).first()[0]
    ends = spark.sql(f"SELECT CAST(-1 AS BIGINT) AS user_id, TIMESTAMP'{FAR}' AS at, CAST(-1 AS BIGINT) AS id, kind FROM VALUES ('click'), ('purchase') AS t(kind)")
    batches = [dealt.filter(F.col("n") == i).drop("n") for i in range(last + 1)]
    side = lambda t, kind: t.filter(F.col("kind") == kind)
    found = _streamed(spark, [*batches, ends, ends], lambda stream: stateful.followed_by(side(stream, "click"), side(stream, "purchase"), "user_id"))
    return found.filter("key >= 0").select(F.col("key").alias("user_id"), F.col("left_id").alias("click"), F.coalesce("right_id", F.lit(-1)).alias("purchase"))


def view_before_purchase(spark, sf_dir):
    """Each purchase with its user's last view at or before it, or -1."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "at", "value", "event_type")
    kind = lambda name: rows.filter(F.col("event_type") == name).drop("event_type")
    found = asof_join(kind("purchase"), kind("view"), "user_id", "at", "event_id")
    return found.select("event_id", "user_id", F.coalesce("match.event_id", F.lit(-1)).alias("view"), F.round(F.col("value") - F.col("match.value"), 2).alias("more"))


def overlapping_sessions(spark, sf_dir):
    """Of each session, how many sessions of other users share time with it, and for how long."""
    own = sessions(_events(spark, sf_dir), "at", "user_id", "30 minutes").filter(F.col("user_id").isNotNull())
    # A user's own sessions share no time, so all others are other users'.
    own = own.select("user_id", F.unix_micros("session_start").alias("start"), F.unix_micros("session_end").alias("end"))
    return overlap_totals(own).filter("n > 0").select("user_id", "start", "n", F.col("shared").alias("micros"))


def trailing_hour(spark, sf_dir):
    """Each event with the number and value of its user's events in the hour up to it, by a frame of time."""
    micros = F.unix_micros("at")
    frame = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-3_600_000_000, Window.currentRow)
    return _events(spark, sf_dir).select("event_id", "user_id", F.count("*").over(frame).alias("n"), F.round(F.sum("value").over(frame), 2).alias("total"))


_SESSIONS = """g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
own AS (SELECT user_id, epoch_us(min(ts)) AS a, epoch_us(max(ts)) + 1800000000 AS z FROM n GROUP BY user_id, s)"""

QUERIES = {f.__name__: f for f in (host_turn_stream, purchases_after_clicks, view_before_purchase, overlapping_sessions, trailing_hour)}
ORACLES = {
    "host_turn_stream": """WITH h AS (SELECT page_id AS seq, url, regexp_extract(lower(url), '^https?://[^/?#]+') AS host, (86400 + page_id // 10) * 1000 AS arrived FROM pages),
n AS (SELECT *, 2000 * row_number() OVER (PARTITION BY host ORDER BY seq) AS n FROM h) SELECT seq, url, CAST(max(arrived - n) OVER (PARTITION BY host ORDER BY seq) + n AS BIGINT) AS turn FROM n""",
    "purchases_after_clicks": "SELECT c.user_id, c.event_id AS click, coalesce(p.event_id, -1) AS purchase FROM events c LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL '30 minutes' WHERE c.event_type = 'click'",
    "view_before_purchase": "SELECT p.event_id, p.user_id, coalesce(v.event_id, -1) AS view, round(p.value - v.value, 2) AS more FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "trailing_hour": "SELECT event_id, user_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)",
    "overlapping_sessions": f"WITH {_SESSIONS} SELECT x.user_id, x.a AS start, count(*) AS n, CAST(sum(least(x.z, y.z) - greatest(x.a, y.a)) AS BIGINT) AS micros FROM own x JOIN own y ON x.user_id <> y.user_id AND x.a < y.z AND y.a < x.z GROUP BY x.user_id, x.a",
}
