"""Streams of files through the same operators, in event-time windows with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources import located


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(located(path))


def windowed(events: DataFrame, time: str, length: str, groups: list[str], aggregates: list[Column], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """aggregates by window and groups; state is dropped once the watermark has passed a window. Also for batches."""
    span = F.window(F.col(time).cast("timestamp"), length, slide or length)
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(span.alias("window"), *groups).agg(*aggregates)
