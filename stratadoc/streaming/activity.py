"""Structured Streaming forms of the activity and session operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, kind, n) per day; a day is final once the watermark has passed it."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(day.alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of the sessions that a gap ends."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def append_monthly(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to the folders of its months. A batch that is run again replaces its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        monthly = batch.withColumn("month", F.date_format("ts", "yyyy-MM"))
        monthly.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["daily_counts", "sessions", "append_monthly"]
