"""Snapshots of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One row per page load. ``status`` is null when there was no response, ``error`` when there was
# no error; ``attempt`` is 2 for the second try of a homepage. ``fetch_id`` is unique.
PAGE_FETCH = (
    "fetch_id BIGINT, site_key STRING, requested_url STRING, attempt INT, final_url STRING, "
    "status INT, html STRING, error STRING"
)


def read_page_fetches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_FETCH).parquet(path)


def stream_page_fetches(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same table as a stream of new files."""
    return (
        spark.readStream.schema(PAGE_FETCH)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )
