"""Structured Streaming over scored events: an extra beyond the reference, which has
no event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream, a few files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def windowed(events: DataFrame, time: str, value: str, kind: str, late: str = "1 day", size: str = "7 days") -> DataFrame:
    """Count, mean and flagged share per time window and kind; the watermark bounds the
    state.  The same expression runs on a batch DataFrame."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.window(time, size).alias("w"), F.col(kind).alias("kind"))
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) >= 50).cast("double")).alias("flagged")).select(F.col("w.start").alias("start"), "kind", "n", "mean", "flagged")


def first_seen(texts: DataFrame, fp: str, time: str, late: str = "1 day") -> DataFrame:
    """Drops fingerprints that were seen within the watermark."""
    return texts.withWatermark(time, late).dropDuplicatesWithinWatermark([fp]) if texts.isStreaming else texts.dropDuplicates([fp])
