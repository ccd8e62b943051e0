"""Ingest of recognised blocks as a stream (an extension: page confidence as pages arrive)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blocks(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def page_confidence(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Mean confidence by page and window of event time (``ts``)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "page_id").agg(F.avg("confidence").alias("confidence"), F.count("*").alias("n_blocks"))
