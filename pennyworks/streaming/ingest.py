"""Incremental reading of event files: duplicates are dropped within the watermark, and balances follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "7 days"


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def daily_totals(events: DataFrame) -> DataFrame:
    """day, event_type, n and total of events(event_id, ts, event_type, value), each event once. Works on streams and tables."""
    if events.isStreaming:
        once = events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
    else:
        once = events.dropDuplicates(["event_id"])
    day = F.window("ts", "1 day").start.alias("day")
    return once.groupBy(day, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(24,6)")).cast("double").alias("total"))


def new_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet, each key once."""
    return rows.dropDuplicates([key]).join(known.select(key), key, "left_anti").select(*rows.columns)
