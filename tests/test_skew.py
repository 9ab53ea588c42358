"""Joins with one hot key give what a plain join gives."""

import pytest
from pyspark.sql import functions as F

from contactline.operators.skew import hot_key_left_join


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(5000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("key"))
    right = spark.range(0, 900, 2).select(
        F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v")
    ).union(spark.createDataFrame([("hot", -1)], "key string, v long"))
    return left, right, sorted(map(tuple, left.join(right, "key", "left").select("id", "v").collect()))


@pytest.mark.parametrize("shares", [1, 10, 100000])
def test_hot_keys(sides, shares):
    left, right, want = sides
    for least in (0, 1000, 10_000):  # some keys hot; one of them, and no key; none
        got = hot_key_left_join(left, right, ["key"], ["id"], shares, least).select("id", "v").collect()
        assert sorted(map(tuple, got)) == want


def test_rows_without_key_are_spread(sides):
    left, right, _ = sides
    joined = hot_key_left_join(
        left.withColumn("key", F.when(F.col("id") < 500, F.col("key"))), right, ["key"], ["id"], 2, 3000)
    assert joined.count() == 5000
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    plain = hot_key_left_join(left, right, ["key"], ["id"])
    assert "_salt" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_a_hot_key_is_dealt_out(sides):
    left, right, _ = sides
    joined = hot_key_left_join(left.withColumn("key", F.lit("hot")), right, ["key"], ["id"], 10, 0)
    assert joined.where("v = -1").count() == 5000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_one_site_with_half_of_all_rows(spark):
    """The largest group that a task gets of the joins of own domains."""
    from contactline.operators import contacts as ct

    rows = spark.range(32_000).select(
        F.when(F.col("id") % 2 == 0, "hot.org").otherwise(F.concat("id", F.lit(".org"))).alias("site_key"),
        F.concat(F.lit("m"), "id", F.lit("@hot.org")).alias("email"))
    domains = rows.select("site_key", F.col("site_key").alias("root_domain")).distinct()
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # else so few rows are put together again
    try:
        kept = ct.own_domain_first(ct.flag_own_domain(rows, domains))
        assert kept.where("site_key = 'hot.org' AND is_own AND kept").count() == 16_000
        sizes = kept.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 12_000
    finally:
        spark.conf.unset(coalesce)
