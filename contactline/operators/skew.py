"""Joins in which one key may hold a large part of the left rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SALT = "_salt"


def hot_key_left_join(
    left: DataFrame, right: DataFrame, on: list[str], salt_by: list[str], shares: int = 1000,
    least: int = 10_000,
) -> DataFrame:
    """Left join to a right side with at most one row per key, where some keys may be hot.

    A key is hot if it holds more than ``least`` rows and more than one part in ``shares`` of all.
    There are fewer than ``shares`` such keys, whatever the data, so their list may pass through the
    driver and be broadcast. Rows of a hot key are dealt out over parts of that size by ``salt_by``,
    and only the right rows of hot keys are copied; left rows without a key are spread if they are
    as many. Where nothing is hot, this is a plain join. ``left`` should be a written table: it is
    read twice more.
    """
    limit = max(left.count() // shares + 1, least)
    found = left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).collect()
    if not found:
        return left.join(right, on, "left")
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    spot = F.xxhash64(*salt_by)
    keys = [r for r in found if all(r[c] is not None for c in on)]
    if not keys:
        salt = F.when(~whole, spot).otherwise(F.lit(0))
        copies = right.withColumn(_SALT, F.lit(0).cast("long"))
        return left.withColumn(_SALT, salt).join(copies, [*on, _SALT], "left").drop(_SALT)
    kinds = T.StructType([*(left.schema[c] for c in on), T.StructField("_parts", T.LongType())])
    hot = F.broadcast(left.sparkSession.createDataFrame(
        [(*(r[c] for c in on), -(-r["_n"] // limit)) for r in keys], kinds))
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.when(~whole, spot).otherwise(F.pmod(spot, parts))
    salted = left.join(hot, on, "left").withColumn(_SALT, salt).drop("_parts")
    copies = (
        right.join(hot, on, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .drop("_parts")
    )
    return salted.join(copies, [*on, _SALT], "left").drop(_SALT)
