"""Cells in parts: put together they are the whole cell, and none is too long."""

import random

import pytest
from pyspark.sql import functions as F

from contactline.operators import contacts as ct
from contactline.operators.cells import SEPARATOR, in_parts

SCHEMA = "k string, j long, v string"


def whole(rows):
    cells = {}
    for k, j, v in rows:
        if v is not None:
            cells.setdefault((k, j), set()).add(v)
    return {key: SEPARATOR.join(sorted(vs, key=lambda v: v.encode())) for key, vs in cells.items()}


def together(parts):
    cells = {}
    for p in sorted(parts, key=lambda p: p["part"]):
        cells.setdefault((p["k"], p["j"]), []).append(p)
    for ps in cells.values():
        assert [p["part"] for p in ps] == list(range(1, len(ps) + 1))
        at = 0
        for p in ps:
            assert p["start"] == at and p["n"] > 0
            at += len(p["text"].encode()) + len(SEPARATOR)
    return {key: SEPARATOR.join(p["text"] for p in ps) for key, ps in cells.items()}


@pytest.mark.parametrize("size", [2, 30, 200, 1 << 20])
def test_random_cells(spark, size):
    rng = random.Random(size)
    rows = [
        (rng.choice(["a", "a", "b", None, ""]), rng.choice([1, None]),
         rng.choice([None, "", "é" * rng.randint(1, 40), str(rng.randint(0, 300)) + "@x.org"]))
        for _ in range(900)]
    parts = in_parts(spark.createDataFrame(rows, SCHEMA).repartition(5), ["k", "j"], "v", size).collect()
    assert together(parts) == whole(rows)


def test_parts_have_at_most_the_size(spark):
    rows = [("a", 1, f"{i}@x.org") for i in range(2000)]
    parts = in_parts(spark.createDataFrame(rows, SCHEMA), ["k", "j"], "v", 64).collect()
    assert max(len(p["text"]) for p in parts) <= 64
    assert together(parts) == whole(rows)


def test_no_rows(spark):
    assert in_parts(spark.createDataFrame([], SCHEMA), ["k", "j"], "v").collect() == []
    assert in_parts(spark.createDataFrame([("a", 1, None)], SCHEMA), ["k", "j"], "v").collect() == []


def test_a_site_with_a_tenth_of_all_addresses(spark):
    """Its cell is longer than a part, no row is, and no task gets more than a range of it."""
    rows = spark.range(400_000).select(
        F.when(F.col("id") % 10 == 0, "hot.org").otherwise(F.concat("id", F.lit(".org"))).alias("site_key"),
        F.concat(F.lit("someone.with.a.long.name"), "id", F.lit("@elsewhere.org")).alias("email"),
        F.lit("Manager Email").alias("category"), F.lit(False).alias("is_own"))
    parts = ct.contact_parts(rows)
    hot = parts.where("site_key = 'hot.org'").orderBy("part").collect()
    assert len(hot) > 2 and max(len(p["text"]) for p in hot) <= 1 << 20
    assert sum(p["n"] for p in hot) == 40_000
    emails = SEPARATOR.join(p["text"] for p in hot).split(SEPARATOR)
    assert emails == sorted(set(emails)) and len(emails) == 40_000
    assert parts.count() == 360_000 + len(hot)
