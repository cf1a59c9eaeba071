"""Exact deduplication of a stream: the first row of each digest passes, later ones don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, text: str = "text", event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """With an event time the state is bounded by the watermark; without, every digest is kept."""
    keyed = stream.withColumn("digest", F.sha2(F.col(text), 256))
    if event_time is None:
        return keyed.dropDuplicates(["digest"])
    return keyed.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"])


def event_counts(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type, late rows up to the watermark included."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks refuse times without a zone
    return timed.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
