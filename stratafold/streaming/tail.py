"""Running block sums over a stream of events, an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by event type and tumbling window; events later than ``late`` are left out."""
    return (
        events.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", late)
        .groupBy(F.window("at", window), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
