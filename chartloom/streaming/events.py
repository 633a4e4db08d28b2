"""Streams of events: windows, first deliveries, intake of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, like: DataFrame, at: str, late: str, pattern: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """Files as they arrive, their time column with a watermark of ``late``."""
    rows = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def windowed(rows: DataFrame, at: str, keys: list[str], length: str, slide: str | None = None) -> DataFrame:
    """Events of each key in tumbling or sliding windows; the same on a table and on a stream."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    return rows.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("w.start", "w.end", *keys, "events", "total")


def sessions(rows: DataFrame, at: str, keys: list[str], gap: str) -> DataFrame:
    """Events of each key that follow each other within ``gap``."""
    return rows.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("events")).select("w.start", "w.end", *keys, "events")


def first_deliveries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key that arrives within the watermark."""
    return rows.dropDuplicatesWithinWatermark(keys)


def current(rows: DataFrame, at: str, now: Column, kept: str = "24 hours") -> DataFrame:
    """Rows no older than ``kept``."""
    return rows.where(F.col(at) >= now - F.expr(f"INTERVAL {kept}"))


def into_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over all that has arrived, then ends; a later run goes on from the checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def intake(rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of arrivals to a function, once each."""
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
