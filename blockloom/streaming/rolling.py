"""Rolling windows over a stream: an extension, as the models' windows are batch loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_rollup(events: DataFrame, size: str = "6 hours", slide: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """start, stop, event_type, n, total: sums over overlapping windows of event time.

    events has ts, event_type and value; rows later than `late` are dropped by the watermark.
    The same frame works on a batch.
    """
    keyed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide)
    return keyed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n", "total")
