"""Settle windows: one firing per burst of events, once the key has been quiet long enough."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Fixed value: seconds of quiet after which a burst has settled.
SETTLE_SECONDS = 1.5


def settle_stream(events: DataFrame, gap: str = "1.5 seconds", key: str = "key", ts: str = "ts", lateness: str = "0 seconds") -> DataFrame:
    """Streaming form: ``(key, window_start, window_end, events)`` in append mode.

    Every event restarts the timer of its key.  The watermark is there because Spark
    needs one to know that a window is complete.
    """
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.col(key), F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events")
    )


@contextmanager
def merged_before_exchange(spark: SparkSession) -> Iterator[None]:
    """Streams started inside merge the sessions of each input partition before they are dealt by key.

    The task of a key with all events then meets bursts, not events.  A stream keeps the
    settings it was started under; those of the session are put back.
    """
    name = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(events: DataFrame, gap_seconds: float = SETTLE_SECONDS, key: str = "key", ts: str = "ts", slice_seconds: float = 3600.0) -> DataFrame:
    """Same windows over a finished table.

    Bursts are first found inside time slices, so a key with a third of all events is
    worked on in parallel.  Only the first and last burst of a slice can go on in
    the neighbouring one; just those are compared along the whole key.
    """
    us = int(round(gap_seconds * 1_000_000))
    step = max(int(slice_seconds * 1_000_000), us)
    e = events.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).withColumn("slice", F.floor(F.col("t") / F.lit(step)))
    inside = Window.partitionBy("k", "slice").orderBy("t")
    fresh = (F.col("t") - F.lag("t").over(inside) >= us).cast("int")
    bursts = (
        e.withColumn("fresh", F.coalesce(fresh, F.lit(0)))
        .withColumn("burst", F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k", "slice", "burst")
        .agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("events"))
        .withColumn("final", F.max("burst").over(Window.partitionBy("k", "slice")))
        .withColumn("edge", (F.col("burst") == 0) | (F.col("burst") == F.col("final")))
    )
    along = Window.partitionBy("k").orderBy("first")
    opened = (F.col("first") - F.lag("last").over(along) >= us).cast("int")
    joined = (
        bursts.where("edge")
        .withColumn("fresh", F.coalesce(opened, F.lit(0)))
        .withColumn("n", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k", "n")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))
    )
    both = joined.select("k", "first", "last", "events").unionByName(bursts.where("not edge").select("k", "first", "last", "events"))
    return both.select(
        F.col("k").alias(key),
        F.timestamp_micros("first").alias("window_start"),
        F.timestamp_micros(F.col("last") + F.lit(us)).alias("window_end"),
        "events",
    )
