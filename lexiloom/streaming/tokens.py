"""Token counts over a stream of documents or events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_types(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Counts of words over a stream of texts; for the update or complete output mode."""
    words = texts.select(*by, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by key and window of event time; rows later than ``late`` are passed over."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
