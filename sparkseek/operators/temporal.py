"""Joins in time that Spark has no operator for: as-of and overlap joins, without nested loops and hot tasks; sums over overlaps without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, order: str, strict: bool = False) -> DataFrame:
    """Left rows with `match`: the last right row of the same `by` whose time is not later (`strict`: earlier); null if there is none.

    Both sides are one table, sorted by key and time and written in chunks of equal size, so a hot key fills several
    chunks. A chunk carries its last right row forward by a window. Only the first key of a chunk can have its match in
    chunks before, which is the last right row of that key in them: one narrow row for each chunk. Of right rows
    of one time, the one greatest by `order` matches; a null key or time matches nothing.
    """
    # Right rows of a time stand before left rows, or after them if only earlier ones match.
    side = lambda n: F.lit(n if not strict else 1 - n).alias("_side")
    keys = [F.col(c).alias(name) for c, name in ((by, "_by"), (time, "_time"), (order, "_order"))]
    rows = left.select(*keys, side(1), F.struct("*").alias("_left"), F.lit(None).cast(right.schema).alias("_right"))
    known = right.filter(F.col(by).isNotNull() & F.col(time).isNotNull())
    rows = rows.unionByName(known.select(*keys, side(0), F.lit(None).cast(left.schema).alias("_left"), F.struct("*").alias("_right")))
    place = ["_by", "_time", "_side", "_order"]
    rows = durable(rows.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_chunk", F.spark_partition_id()))
    ends = rows.groupBy("_chunk", "_by").agg(_last_right().alias("_end"))
    before = Window.partitionBy("_by").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("_chunk").agg(F.min(F.struct(F.col("_by").isNotNull(), "_by")).alias("_f")).select(F.col("_chunk").alias("_c"), F.col("_f._by").alias("_key"))
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).join(F.broadcast(first), (F.col("_chunk") == F.col("_c")) & (F.col("_by") == F.col("_key"))).select("_c", "_key", "_carry")
    within = Window.partitionBy("_chunk", "_by").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_match", F.last("_right", ignorenulls=True).over(within)).filter(F.col("_left").isNotNull())
    rows = rows.join(F.broadcast(carried), (F.col("_chunk") == F.col("_c")) & (F.col("_by") == F.col("_key")), "left")
    return rows.select("_left.*", F.when(F.col("_time").isNotNull(), F.coalesce("_match", "_carry")).alias("match"))


def _last_right() -> Column:
    return F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_time", "_order")))


def overlap_join(left: DataFrame, right: DataFrame, width: float, by: tuple[str, ...] = (), start: str = "start", end: str = "end") -> DataFrame:
    """Pairs a (left row), b (right row) whose intervals [start, end) share time, and whose `by` columns are equal.

    Intervals (numbers or timestamps; `width` in their unit or seconds) stand in every bin of `width` that they touch, and
    two meet in the first bin that both touch, which is the bin of the later start; so each pair comes up once,
    through an equality join. Bins should be about as wide as most intervals: an interval of n widths has n rows.
    Empty and null intervals share no time.
    """
    bin_of = lambda c: F.floor((c if dict(left.dtypes)[start] not in ("timestamp", "timestamp_ntz") else c.cast("timestamp").cast("double")) / F.lit(float(width)))

    def binned(rows: DataFrame, name: str) -> DataFrame:
        s, e = F.col(start), F.col(end)
        rows = rows.filter(s < e).select(F.struct("*").alias(name), *[F.col(c).alias(f"_{name}_{c}") for c in by], s.alias(f"_{name}_start"), e.alias(f"_{name}_end"))
        first, last = bin_of(F.col(f"_{name}_start")), bin_of(F.col(f"_{name}_end"))
        return rows.withColumn(f"_{name}_first", first).withColumn(f"_{name}_bin", F.explode(F.sequence(first, last)))

    a, b = binned(left, "a"), binned(right, "b")
    same = F.col("_a_bin") == F.col("_b_bin")
    for c in by:
        same = same & (F.col(f"_a_{c}") == F.col(f"_b_{c}"))
    once = F.col("_a_bin") == F.greatest("_a_first", "_b_first")
    return a.join(b, same & once & (F.col("_a_start") < F.col("_b_end")) & (F.col("_b_start") < F.col("_a_end"))).select("a", "b")


def overlap_totals(rows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The rows with n, how many other rows' intervals [start, end) share time with theirs, and shared, the sum of those times.

    No pair is made, so the work grows with the rows whatever the number of overlaps. Starts before an interval's end,
    less ends up to its start, are those it meets; the integral of the number of open intervals over it is the time
    shared. Both are differences of running sums over all borders in order of time: the borders are written in
    sorted chunks, each chunk sums its own, and one row for each chunk carries the sums of those before. Times are
    whole numbers; rows with an empty or null interval share no time and are left out.
    """
    rows = rows.filter(F.col(start) < F.col(end))
    border = lambda c, a, z: rows.select(F.col(c).cast("long").alias("_t"), F.lit(a).alias("_a"), F.lit(z).alias("_z"))
    times = border(start, 1, 0).unionByName(border(end, 0, 1)).groupBy("_t").agg(F.sum("_a").alias("_a"), F.sum("_z").alias("_z"))
    chunks = durable(times.repartitionByRange("_t").sortWithinPartitions("_t").withColumn("_chunk", F.spark_partition_id()))
    # Of an open interval the sum has its start, of a closed one its length; whole numbers of 38 digits hold it.
    moved = ((F.col("_z") - F.col("_a")).cast("decimal(20,0)") * F.col("_t").cast("decimal(18,0)")).cast("decimal(38,0)")
    own = {"_a": F.col("_a"), "_z": F.col("_z"), "_m": moved}
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each chunk
    sums = chunks.groupBy("_chunk").agg(*[F.sum(c).alias(name) for name, c in own.items()])
    carried = sums.select("_chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in own])
    within = Window.partitionBy("_chunk").orderBy("_t")
    upto = chunks.select("_chunk", "_t", "_a", *[F.sum(c).over(within).alias(f"{name}1") for name, c in own.items()]).join(F.broadcast(carried), "_chunk")
    a, z, m = (F.col(f"{c}1") + F.col(f"{c}0") for c in own)
    # At a border: starts before it, ends up to it, and the time that all intervals were open before it.
    area = (m + (a - z).cast("decimal(20,0)") * F.col("_t").cast("decimal(18,0)")).cast("decimal(38,0)")
    at = durable(upto.select("_t", (a - F.col("_a")).alias("_starts"), z.alias("_ends"), area.alias("_area")))
    at_start = at.select(F.col("_t").alias("_s"), F.col("_ends").alias("_gone"), F.col("_area").alias("_from"))
    at_end = at.select(F.col("_t").alias("_e"), F.col("_starts").alias("_come"), F.col("_area").alias("_to"))
    found = rows.withColumns({"_s": F.col(start).cast("long"), "_e": F.col(end).cast("long")}).join(at_start, "_s").join(at_end, "_e")
    shared = F.col("_to") - F.col("_from") - (F.col("_e") - F.col("_s"))
    return found.withColumns({"n": F.col("_come") - F.col("_gone") - 1, "shared": shared.cast("long")}).select(*rows.columns, "n", "shared")
