"""Event streams: tumbling windows with a watermark, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and users per window and type. late: the watermark on a stream (rows later than that are dropped)."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over Parquet files of events as they arrive in a folder."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder)


def weekly_event_chart(events: DataFrame, top: int = 10) -> DataFrame:
    """A weekly chart of users by number of events, in the shape of chart entries."""
    from pyspark.sql import Window

    each = events.groupBy("event_type", F.date_trunc("week", "ts").cast("date").alias("week_van"), "user_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("event_type", "week_van").orderBy(F.desc("n"), "user_id")
    return each.withColumn("positie", F.row_number().over(order)).where(F.col("positie") <= top)
