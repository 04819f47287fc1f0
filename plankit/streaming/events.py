"""Streams of events: windowed counts with a watermark, for sources that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) for each tumbling window; on a stream, events later than that are left out.

    State is bounded by the watermark. Works on a table as well, where the watermark has no effect.
    """
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    counted = grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")
