"""Incremental mode on Structured Streaming: extraction of arriving pages, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import extract_pages


def extract_stream(pages: DataFrame, **settings) -> DataFrame:
    """extract_pages over a stream of (page_id, url, html): every page is on its own, so no state is kept."""
    return extract_pages(pages, spread=False, **settings)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(event_type, start, n, value) by tumbling windows; events later than `late` are dropped by the watermark."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("event_type", F.col("w.start").alias("start"), "n", "value")
