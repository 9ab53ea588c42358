"""Delimited files with line breaks inside quotes, read in pieces by many tasks.

Whether a line begins inside quotes depends on all lines before it, but a line can only do one of four
things with that: leave it, turn it round, or end inside or outside quotes either way. What several
lines do one after the other is again one of the four. So each piece of a file is summed up to one
step, the steps of the pieces before it tell how a piece begins, and lines are put together to records
where they belong to one. Only lines of records with line breaks are moved for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactline.runtime import materialise

# A cell without its delimiter. A quote counts where a cell begins; two of them in quotes are a sign of
# the text; what follows the last one up to the delimiter belongs to the cell.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_CELL = rf'(?:{_QUOTED}"[^,]*+|(?!")[^,]*+)'
_OPEN = rf"(?:{_CELL},)*+{_QUOTED}\z"
# Lines that end inside quotes: if they begin outside, or inside.
_LEFT_OPEN = rf"\A{_OPEN}"
_STILL_OPEN = rf'\A[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,{_OPEN})'


def _lines(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """``file, block, n, line, opens, stays``: lines in their order (``n``) in a piece of a file, and
    whether they end inside quotes when they begin outside or inside."""
    raw = spark.read.option("lineSep", "\n").text(files)
    # A text of any length, in memory as the bytes of the file.
    line = F.decode(F.col("value").cast("binary"), encoding)
    rows = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        F.regexp_replace(line, r"\r\z", "").alias("line"))
    quoted = F.col("line").contains('"')
    return materialise(
        rows.select("*", (quoted & F.col("line").rlike(_LEFT_OPEN)).alias("opens"),
                    (~quoted | F.col("line").rlike(_STILL_OPEN)).alias("stays")), "lines")


def _before(rows: DataFrame, part: list[str], order: str, opens: Column, stays: Column) -> DataFrame:
    """Adds ``fixed`` (how the rows before a row leave the state, whatever it was; null if that depends
    on it) and ``turned`` (whether they then turn it round)."""
    past = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = (opens & ~stays).cast("int")
    rows = rows.withColumn("_turns", F.coalesce(F.sum(turns).over(past), F.lit(0)) % 2)
    # The last row that ends one way or the other, seen from the beginning.
    end = F.when(opens == stays, opens.cast("int").bitwiseXOR(F.col("_turns")))
    rows = rows.withColumn("_end", end)
    return rows.withColumn("fixed", F.last("_end", ignorenulls=True).over(past)).withColumnRenamed(
        "_turns", "turned").drop("_end")


def _state(begin: Column) -> Column:
    """Whether a row begins inside quotes, if the first one does or does not (0 or 1)."""
    return F.coalesce(F.col("fixed"), begin).bitwiseXOR(F.col("turned")) == 1


def records(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """``file, block, n, record``: the records of the files, blank ones left out, at the place of
    their first line. Line breaks in a record are ``\\n``."""
    lines = _lines(spark, files, encoding)
    whole = Window.partitionBy("file", "block")
    last = whole.orderBy(F.col("n").desc())
    inside = _before(lines.select("file", "block", "n", "opens", "stays"), ["file", "block"], "n",
                     F.col("opens"), F.col("stays"))
    # What a piece does as a whole: what its last line makes of what the lines before it do.
    ends = inside.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    after = lambda begin: F.when(_state(F.lit(begin)), F.col("stays")).otherwise(F.col("opens"))
    pieces = ends.select("file", "block", after(0).alias("opens"), after(1).alias("stays"))
    begins = _before(pieces, ["file"], "block", F.col("opens"), F.col("stays")).select(
        "file", "block", _state(F.lit(0)).cast("int").alias("_begin"))
    placed = inside.join(begins, ["file", "block"]).select(
        "file", "block", "n", _state(F.col("_begin")).alias("goes_on"),
        F.when(_state(F.col("_begin")), F.col("stays")).otherwise(F.col("opens")).alias("open"))
    placed = materialise(placed, "line_states")

    # A line that goes on belongs to the last one before it that does not, in this piece or an earlier.
    at = F.when(~F.col("goes_on"), F.struct("block", "n"))
    own = Window.partitionBy("file", "block").orderBy("n").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = placed.groupBy("file", "block").agg(F.max(at).alias("_last")).select(
        "file", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"))
    long = placed.where("goes_on OR open").withColumn("_own", F.last(at, ignorenulls=True).over(own))
    parts = long.join(lasts, ["file", "block"]).join(lines, ["file", "block", "n"]).select(
        "file", F.coalesce("_own", "_earlier").alias("at"), F.struct("block", "n", "line").alias("part"))
    joined = parts.groupBy("file", "at").agg(F.sort_array(F.collect_list("part")).alias("parts")).select(
        "file", "at.block", "at.n",
        F.array_join(F.transform("parts", lambda p: p.line), "\n").alias("record"))
    short = lines.join(placed.where("NOT goes_on AND NOT open"), ["file", "block", "n"], "left_semi")
    return short.select("file", "block", "n", F.col("line").alias("record")).unionByName(joined).where(
        F.trim("record") != "")


def read_in_pieces(
    spark: SparkSession, files: list[str], encoding: str, schema: str, options: dict,
) -> DataFrame:
    """Rows of files with a header line, all columns as text, with ``_file``, ``_block`` and ``_row``."""
    rows = records(spark, files, encoding)
    first = rows.groupBy("file").agg(F.min(F.struct("block", "n")).alias("_h"))
    body = rows.join(first, "file").where(F.struct("block", "n") != F.col("_h"))
    cells = F.from_csv("record", schema, {k: str(v) for k, v in options.items() if k != "header"})
    return body.select(cells.alias("_c"), "file", "block", "n").select(
        "_c.*", F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("n").alias("_row"))
