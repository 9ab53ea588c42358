"""Cells of any length: the sorted values of a key in numbered parts of bounded size.

A cell that holds all values of its key in one row is as long as the key has values. Here the values
are sorted over many tasks by ranges of key and value, each is given the place at which it begins in
its cell, and the place tells its part. No task holds more of a cell than a range or a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactline.runtime import materialise

#: Bytes of a part.
PART = 1 << 20
SEPARATOR = ", "


def in_parts(rows: DataFrame, keys: list[str], value: str, size: int = PART) -> DataFrame:
    """``keys, part, start, n, text``: the distinct values of each cell, sorted and joined.

    ``part`` counts from 1 and has no gaps, ``start`` is the byte of the cell at which it begins, and
    the texts of a cell, joined in order of ``part`` by SEPARATOR, are the whole cell. A part has at
    most ``size`` bytes, or one value that is longer than half of it and what comes before. Values
    that are null are left out, so a cell without others has no parts; a null key is a key.
    """
    width = max(1, size // 2)  # a part ends with the value that begins in its last byte
    step = F.octet_length("_value") + F.lit(len(SEPARATOR))
    distinct = rows.select(*keys, F.col(value).alias("_value")).where("_value IS NOT NULL").distinct()
    order = [*keys, "_value"]
    placed = materialise(
        distinct.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id()), "cell_ranges")
    sums = placed.groupBy("_range", *keys).agg(F.sum(step).alias("_bytes"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.currentRow - 1)
    # Rows lie in the order of the keys, so of a range only the first cell began in an earlier one:
    # this has no more rows than there are ranges.
    carried = F.broadcast(
        sums.select("_range", *keys, F.sum("_bytes").over(before).alias("_before"))
        .where("_before IS NOT NULL")
        .select(F.col("_range").alias("_r"), "_before", *(F.col(k).alias(f"_{k}") for k in keys)))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = Window.partitionBy("_range", *keys).orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow - 1)
    started = placed.join(carried, same, "left").select(
        *keys, "_value",
        (F.coalesce("_before", F.lit(0)) + F.coalesce(F.sum(step).over(within), F.lit(0))).alias("_start"))
    parts = started.groupBy(*keys, F.floor(F.col("_start") / width).alias("_part")).agg(
        F.min("_start").alias("start"),
        F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_list("_value")), SEPARATOR).alias("text"),
    )
    # Values longer than a part leave numbers out; parts are few next to values.
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_part"))
    return parts.select(*keys, number.cast("long").alias("part"), "start", "n", "text")


def write_parts(parts: DataFrame, keys: list[str], folder: str, fmt: str = "parquet", **options) -> None:
    """Writes parts in the order of their cells over many files."""
    (
        parts.repartitionByRange(*keys, "part").sortWithinPartitions(*keys, "part")
        .write.format(fmt).options(**options).save(folder)
    )
