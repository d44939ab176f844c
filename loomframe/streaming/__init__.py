"""Streams over folders: chunked CSV sources and sinks, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)


def csv_sink(sdf: DataFrame, path: str, checkpoint: str):
    return sdf.writeStream.format("csv").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def map_batches(sdf: DataFrame, func, schema: str) -> DataFrame:
    return sdf.mapInPandas(lambda it: map(func, it), schema)


def reduce_by_key(sdf: DataFrame, key: str, *aggs) -> DataFrame:
    return sdf.groupBy(key).agg(*aggs)


def windowed(sdf: DataFrame, ts: str, width: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts of tumbling windows; rows later than ``late`` are dropped, and with them their windows' state."""
    return sdf.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).count()
