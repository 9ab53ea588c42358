"""From a raw table with loosely named columns to numbered, valid services."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactline.functions.text import absent_to_null, strip
from contactline.rules import (
    DEFAULT_RULES,
    NULL_TOKENS,
    POSTCODE,
    SERVICE_NAME,
    SERVICE_WEBSITE,
    Rules,
)
from contactline.runtime import materialise


def normal_header(name: str) -> str:
    """Header spelling used for comparison."""
    return re.sub(r"\s+", " ", str(name).lower().strip().replace("_", " "))


def header_mapping(columns: list[str], rules: Rules = DEFAULT_RULES) -> dict[str, str]:
    """Original header → canonical name. The first fitting column of the file is taken."""
    mapping: dict[str, str] = {}
    for canonical, aliases in rules.column_aliases:
        # Equal without blanks covers equal with them.
        accepted = {normal_header(a).replace(" ", "") for a in aliases}
        fitting = (
            c for c in columns
            if c not in mapping and normal_header(c).replace(" ", "") in accepted
        )
        taken = next(fitting, None)
        if taken is not None:
            mapping[taken] = canonical
    if SERVICE_NAME not in mapping.values():
        raise ValueError(
            f"no service name column among {list(columns)}; "
            f"accepted: {list(dict(rules.column_aliases)[SERVICE_NAME])}"
        )
    return mapping


def map_headers(df: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Rename known columns to their canonical names; a later column of such a name is dropped."""
    mapping = header_mapping(df.columns, rules)
    taken = set(mapping.values())
    return df.select(
        *(
            F.col(f"`{c}`").alias(mapping.get(c, c))
            for c in df.columns
            if c in mapping or c not in taken
        )
    )


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """Texts that stand for "no value" in a delimited file become null, in every text column."""
    def column(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(~c.isin(*NULL_TOKENS), c).alias(name) if kind == "string" else c

    return df.select(*(column(n, t) for n, t in df.dtypes))


def has_name(name: Column) -> Column:
    return absent_to_null(name).isNotNull()


def valid_services(df: DataFrame) -> DataFrame:
    """Rows with a name, the name stripped."""
    name = F.col(f"`{SERVICE_NAME}`")
    return df.where(has_name(name)).withColumn(SERVICE_NAME, strip(name))


def rejected_services(df: DataFrame) -> DataFrame:
    """Rows without a name, as they came."""
    return df.where(~has_name(F.col(f"`{SERVICE_NAME}`")))


def number_in_order(df: DataFrame, order: list[str], out: str = "service_num") -> DataFrame:
    """1-based position of each row in the order of some columns, which must tell rows apart.

    The rows are sorted over many tasks by ranges of these columns and written down; a row's number
    is its place in its range plus the sizes of the ranges before, of which there are as many as
    partitions. Keys may lie as far apart, or as close together, as they like.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    written = materialise(
        ranges.withColumn("_part", F.shiftright(place, 33).cast("int"))
        .withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = {r["_part"]: r["n"] for r in written.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    start = F.get(F.array(*(F.lit(s).cast("long") for s in starts or [0])), F.col("_part"))
    return written.withColumn(out, start + F.col("_place") + 1).drop("_part", "_place")


def number_by_key(df: DataFrame, key: str, out: str = "service_num") -> DataFrame:
    """1-based position of each row in the order of a unique key."""
    return number_in_order(df, [key], out)


def number_by_file_position(df: DataFrame, out: str = "service_num") -> DataFrame:
    """1-based position of the rows of a file scan, in file order: by the ``_file``, ``_block`` and
    ``_row`` columns, which are dropped."""
    return number_in_order(df, ["_file", "_block", "_row"], out).drop("_file", "_block", "_row")


def load_summary(df: DataFrame) -> DataFrame:
    """One row: total, with and without website, repeated names, invalid rows skipped.

    ``df`` is the mapped table with its invalid rows. Repeated names stay in the data.
    """
    name = absent_to_null(F.col(f"`{SERVICE_NAME}`"))
    website = (
        absent_to_null(F.col(f"`{SERVICE_WEBSITE}`"))
        if SERVICE_WEBSITE in df.columns else F.lit(None).cast("string")
    )
    # Counts per name first: partial sums leave the map side, and no name is hot.
    per_name = df.groupBy(name.alias("name")).agg(
        F.count("*").alias("n"), F.count(website).alias("with_website")
    )
    named = F.col("name").isNotNull()
    count = lambda c: F.coalesce(F.sum(F.when(named, c)), F.lit(0))
    return per_name.agg(
        count(F.col("n")).alias("total"),
        count(F.col("with_website")).alias("with_website"),
        count(F.col("n") - F.col("with_website")).alias("without_website"),
        count(F.col("n") - 1).alias("duplicates"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("invalid_skipped"),
    )


def as_services(df: DataFrame, *keep: str) -> DataFrame:
    """Numbered, mapped rows under the internal names; absent optional columns become null. Columns
    to ``keep`` follow."""
    def column(name):
        return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")

    return df.select(
        "service_num",
        strip(column(SERVICE_NAME)).alias("service_name"),
        column(SERVICE_WEBSITE).alias("service_website"),
        column(POSTCODE).alias("postcode"),
        *keep,
    )
