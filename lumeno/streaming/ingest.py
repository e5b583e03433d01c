"""Snapshots as a stream: new page files in, each actual URL once, jobs marked done as their pages arrive (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page_id long, url string, actual_url string, captured_at timestamp, html string"


def pages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_pages(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The first snapshot of each actual URL within the watermark; later ones than that are state no more, so it stays bounded."""
    return stream.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["actual_url"])


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Snapshots by host and hour."""
    from lumeno.functions.text import url_host

    timed = stream.withWatermark("captured_at", late).withColumn("host", url_host(F.col("url")))
    return timed.groupBy(F.window("captured_at", "1 hour").alias("w"), "host").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "host", "n")
