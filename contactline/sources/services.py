"""Reading the table of services from delimited files or Parquet."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactline.operators.ingest import (
    map_headers,
    null_tokens_to_null,
    number_by_file_position,
    number_by_key,
    valid_services,
)
from contactline.sources.pieces import read_in_pieces

_CSV = {"header": True, "quote": '"', "escape": '"'}


def _file_profile(spark: SparkSession, path: str) -> list:
    """Which files are not UTF-8, and which may have line breaks inside quotes.

    Lines are read as raw bytes in splittable pieces, so no file is held whole. One row per file
    comes back to the driver, which lists the files anyway.
    """
    lines = spark.read.text(path, pathGlobFilter="*.[cC][sS][vV]").select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return (
        lines.groupBy("file")
        .agg(
            F.every(F.is_valid_utf8("value")).alias("utf8"),
            F.some(quotes % 2 == 1).alias("broken_lines"),
        )
        .collect()
    )


def _unique_headers(names: list[str]) -> list[str]:
    """Repeated names get .1, .2 and so on; empty ones a name by position."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = name if name not in (None, "") else f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with ``_file``, ``_block`` and ``_row`` for the position of a row.

    Each file is read as UTF-8 if it is that, else as Latin-1. All files must have the same header
    line. Files are read in pieces, also those with line breaks in quotes (``sources.pieces``).
    """
    profile = _file_profile(spark, path)
    if not profile:
        raise ValueError(f"the input {path!r} is empty")
    groups: dict[tuple[str, bool], list[str]] = {}
    for row in profile:
        key = ("UTF-8" if row.utf8 else "ISO-8859-1", bool(row.broken_lines))
        groups.setdefault(key, []).append(unquote(row.file))

    parts, header = [], None
    for (encoding, multiline), files in sorted(groups.items()):
        reader = spark.read.options(**_CSV, encoding=encoding)
        first = spark.read.options(
            **(_CSV | {"header": False}), encoding=encoding, multiLine=multiline
        ).csv(sorted(files)[0]).first()
        names = _unique_headers(list(first))
        if header is None:
            header = names
        elif names != header:
            raise ValueError(f"files of {path!r} differ in their headers")
        schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
        if multiline:
            parts.append(read_in_pieces(spark, files, encoding, schema, _CSV))
            continue
        # Spark compares each file's header with ours, unless we had to rename repeated ones.
        renamed = names != list(first)
        parts.append(
            reader.schema(schema).option("enforceSchema", renamed).csv(files).select(
                "*",
                F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_row"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Mapped table with invalid rows, by file type; for the load summary and rejected rows."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix == "parquet":
        return map_headers(spark.read.parquet(path))
    if suffix in ("", "csv"):
        return map_headers(null_tokens_to_null(read_csv(spark, path)))
    raise ValueError(f"unsupported file type {suffix!r}; supported: csv, parquet")


def read_services(spark: SparkSession, path: str, order_by: str | None = None) -> DataFrame:
    """Valid rows of a delimited file (or folder of them) with ``service_num`` in file order, or of
    Parquet files in the order of the unique column ``order_by``."""
    raw = read_raw(spark, path)
    if raw.isEmpty():
        raise ValueError(f"the input {path!r} is empty")
    valid = valid_services(raw)
    if valid.isEmpty():
        raise ValueError(f"no valid service records in {path!r}")
    if "_file" not in raw.columns:
        if order_by is None:
            raise ValueError("Parquet rows have no order: name a column to number them by")
        return number_by_key(valid, order_by)
    return number_by_file_position(valid)
