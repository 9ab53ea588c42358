"""The three result tables, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from contactline.functions.text import strip
from contactline.rules import (
    ENRICHED_COLUMNS,
    FAILED,
    FAILED_COLUMNS,
    STATUS,
    SUCCESS,
    SUCCESS_COLUMNS,
)


# Cells are written as they are, outer blanks included.
CSV_WRITE = {
    "header": True, "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _columns(df: DataFrame, names) -> list[Column]:
    return [
        F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) if n in df.columns else F.lit("").alias(n)
        for n in names
    ]


def _has_status(wanted: str) -> Column:
    return F.lower(strip(F.coalesce(F.col(f"`{STATUS}`"), F.lit("")))) == wanted.lower()


def enriched_table(df: DataFrame) -> DataFrame:
    """The ten result columns in order; those the table lacks are empty."""
    return df.select("service_num", *_columns(df, ENRICHED_COLUMNS))


def success_table(enriched: DataFrame) -> DataFrame:
    return enriched.where(_has_status(SUCCESS)).select("service_num", *SUCCESS_COLUMNS)


def failed_table(enriched: DataFrame) -> DataFrame:
    return enriched.where(_has_status(FAILED)).select("service_num", *FAILED_COLUMNS)


def _counts() -> list[Column]:
    return [
        F.count("*").alias("total_rows"),
        F.count_if(_has_status(SUCCESS)).alias("success_rows"),
        F.count_if(_has_status(FAILED)).alias("failed_rows"),
    ]


def status_counts(enriched: DataFrame) -> DataFrame:
    return enriched.agg(*_counts())


def write_results(enriched: DataFrame, folder: str, fmt: str = "parquet") -> dict[str, int]:
    """Write services_enriched, services_success and services_failed in input order; gives
    ``total_rows, success_rows, failed_rows`` as counted while the first was written.

    ``enriched`` should be a written table: it is read three times.
    """
    options = CSV_WRITE if fmt == "csv" else {}
    counted = Observation()
    tables = {
        "services_enriched": enriched,
        "services_success": success_table(enriched),
        "services_failed": failed_table(enriched),
    }
    for name, table in tables.items():
        # A range partitioning keeps the order across files without one task sorting all.
        ordered = table.repartitionByRange("service_num").sortWithinPartitions("service_num")
        if table is enriched:
            # After the sort: below it, finding the ranges would count the rows once more.
            ordered = ordered.observe(counted, *_counts())
        (
            ordered.drop("service_num")
            .write.mode("overwrite")
            .format(fmt)
            .options(**options)
            .save(f"{folder}/{name}")
        )
    return counted.get
