"""The operators over streams: stateless filters, and duplicates within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup


def documents_stream(spark, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def dedup_stream(docs: DataFrame, time: str, text: str = "text", within: str = "1 day") -> DataFrame:
    """First document of each key within a watermark; state older than that is dropped."""
    keyed = docs.withColumn("_key", dedup.document_key(F.col(text))).withWatermark(time, within)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and value; late rows beyond the watermark aren't counted."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
