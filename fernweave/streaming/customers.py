"""An extension: the current state of customers and sessions of events, kept up by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, events, value of sessions: events of a user with less than the gap between them.

    Works on streams and on tables. Events later than the watermark are left out of a stream.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    grouped = timed.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return grouped.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "value")


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, event_type, events, value: tumbling windows."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "events", "value")


def last_purchases(purchases: DataFrame) -> DataFrame:
    """customer_id, last_date, purchases: a running state, for update or complete output."""
    return purchases.groupBy("customer_id").agg(F.max("purchase_date").alias("last_date"), F.count(F.lit(1)).alias("purchases"))
