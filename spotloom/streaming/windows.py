"""Windowed counts of events: the same plan for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """Count and sum of values by event type and hour.  On a stream, set a watermark first to bound the state."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return events.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start_"), "n", "total")


def stream(spark: SparkSession, folder: str, schema, late: str = "10 minutes") -> DataFrame:
    """hourly() over files that arrive in a folder."""
    src = spark.readStream.schema(schema).parquet(folder)
    return hourly(src.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))
