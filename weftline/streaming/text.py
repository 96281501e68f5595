"""Word counts over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import words


def word_count(stream: DataFrame, text: str = "text", count: str = "count", time: str | None = None, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Words and counts of a streaming DataFrame: of all time, or by event-time window with a watermark if a time column is named."""
    if time is None:
        return stream.select(F.explode(words(F.col(text))).alias(text)).groupBy(text).agg(F.count("*").alias(count))
    found = stream.withWatermark(time, late).select(F.col(time), F.explode(words(F.col(text))).alias(text))
    return found.groupBy(F.window(time, window).alias("window"), text).agg(F.count("*").alias(count)).select(F.col("window.start").alias("start"), text, count)
