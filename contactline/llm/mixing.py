"""Mixing sources to target weights by systematic sampling.

A document of a source is expected ``target / source_size`` times. These expectations are summed up
along the source, one offset per source is added, and the document is taken once for each whole
number that its step crosses. Documents stand in the order of their size, so that every range of
sizes gives its share and the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactline.llm.common import n_words, numbered_whole

#: Documents of one source and size that one task ranks, about.
BLOCK = 512
#: Hexadecimal digits of a hash that make a number exactly held by a double.
DIGITS = 13


def _spread(column: Column, salt: str) -> Column:
    """A number from 0 up to 16 ** DIGITS that depends on a value and a salt."""
    text = F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``. One row per source, so the order
    of all sources is one small sort.

    Sources are weighed in code point order (null last). What a source would get beyond ``most``
    times its size goes to the others by weight until none is above: in the order of
    size / weight, a source is full if its share of what is left then reaches its limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.select(
        "*", F.element_at(F.array(*map(F.lit, weights)), place + 1).alias("_w"),
        (F.col("source_size") * most).alias("_cap"),
    )
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(past), F.lit(0)))
        .alias("_left"),
        F.sum("_w").over(rest).alias("_weights"),
    )
    level = F.col("_left").cast("double") / F.col("_weights").cast("double")
    rows = rows.select(
        "*", level.alias("_level"), (level * F.col("_w") >= F.col("_cap")).alias("_full"))
    common = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(every)
    return rows.select(
        "source", "source_size",
        F.when(F.col("_full"), F.col("_cap").cast("double"))
        .otherwise(common["_level"] * F.col("_w")).alias("target"),
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix",
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken``.

    Every row is returned, those with 0 copies too. Null texts have size 0, null sources are one
    source after all others, rows that repeat a ``doc_id`` are documents of their own, sources
    without words have target 0, and no table gives no rows. ``copies`` depends on the rows alone,
    not on their order or partitions; equal rows are exchangeable.
    """
    docs = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    by_size = docs.groupBy("source", "size").agg(F.count("*").alias("_rows"))
    sizes = by_size.groupBy("source").agg(F.sum(F.col("_rows") * F.col("size")).alias("source_size"))
    goals = targets(sizes, weights, most)

    hashed = docs.withColumn("_h", _spread(F.col("doc_id"), seed))
    parts = F.ceil(F.col("_rows") / BLOCK)
    split = by_size.select(F.col("source").alias("_s"), F.col("size").alias("_z"), parts.alias("_parts"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    hashed = hashed.join(split, same).drop("_s", "_z")
    # Blocks in the order of the hash, so that the order of all rows is (size, hash, doc_id).
    block = F.floor(F.col("_h") / F.lit(16.0**DIGITS) * F.col("_parts"))
    hashed = hashed.withColumn("_block", block)
    counts = hashed.groupBy("source", "size", "_block").agg(F.count("*").alias("_rows"))
    before = (
        Window.partitionBy("source").orderBy("size", "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    unit = _spread(F.col("source"), f"{seed} offset ") / F.lit(16.0**DIGITS)
    starts = counts.select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_block").alias("_b"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    ).join(
        goals.select(F.col("source").alias("_g"), "source_size", "target", unit.alias("_unit")),
        F.col("_s").eqNullSafe(F.col("_g")),
    ).drop("_g")
    inside = Window.partitionBy("source", "size", "_block").orderBy("_h", "doc_id")
    ranked = hashed.withColumn("_i", F.row_number().over(inside)).join(
        starts, same & (F.col("_block") == F.col("_b")))
    rank = F.col("_before") + F.col("_i")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def crossed(n: Column) -> Column:
        return F.floor(F.col("_unit") + n * step)

    copies = (crossed(rank) - crossed(rank - 1)).cast("long")
    return ranked.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: ``docs``, all columns, each as many times as it is taken, and ``copy`` (from
    1), or ``copy_`` and so on where ``docs`` has that name. Texts are moved once; the choice is made
    without them."""
    rows = numbered_whole(docs)
    chosen = mix(rows.select(F.col("row").alias("doc_id"), "text", "rest.source"), **how).where(
        "copies > 0").select(F.col("doc_id").alias("_row"), "copies")
    copies = rows.join(chosen, F.col("row") == F.col("_row")).select(
        "text", "rest", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    number = "copy"
    while number in {c.lower() for c in docs.columns}:
        number += "_"
    return copies.select(
        *[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns],
        F.col("copy").alias(number))


#: DuckDB SQL for the rows of ``mix`` over ``documents``.
SQL = f"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w,
             3 * source_size AS cap,
             sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio,
        (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
l AS (SELECT arg_min(level, (ratio, level)) AS level FROM r WHERE level * w < cap),
g AS (SELECT source, source_size,
        CASE WHEN r.level * w >= cap THEN cap::DOUBLE ELSE l.level * w END AS target,
        ('0x' || substr(md5('mix offset ' || coalesce(source, '')), 1, {DIGITS}))::BIGINT
          / 16.0::DOUBLE ** {DIGITS} AS unit
      FROM r LEFT JOIN l ON true),
n AS (SELECT d.*, source_size, target, unit,
        row_number() OVER (PARTITION BY d.source ORDER BY size, h, doc_id) AS i,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (floor(unit + i * step) - floor(unit + (i - 1) * step))::BIGINT AS copies,
  ((floor(unit + i * step) - floor(unit + (i - 1) * step))::BIGINT * size) AS taken
FROM n
"""
