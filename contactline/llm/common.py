"""What several operators share: reading, row numbers, words as hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactline.runtime import bounded_batches, materialise

#: A word: any run of characters without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, key: str, *columns: str) -> tuple[DataFrame, bool]:
    """``row`` (long, unique, in the order of ``key``), ``key`` and ``columns``; whether ``row`` is
    the key itself.

    Where the keys are unique and not null, ``row`` is the key and nothing is moved. Otherwise all
    rows are sorted by key (nulls last), the first of the columns and the others as text, and
    numbered: rows that repeat a key count as later ones, and only rows equal in all columns are
    exchangeable.
    """
    bounded_batches(df.sparkSession)
    df = df.select(F.col(key).cast("long").alias(key), *columns)
    odd = df.select(key).groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1))
    if odd.isEmpty():
        return df.select(F.col(key).alias("row"), key, *columns), True
    ties = [F.to_json(F.struct(*columns[1:]))] if len(columns) > 1 else []
    order = df.orderBy(F.col(key).asc_nulls_last(), columns[0], *ties)
    return materialise(
        order.select(F.monotonically_increasing_id().alias("row"), key, *columns), "numbered"), False


def named(rows: DataFrame, plain: bool, key: str, found: DataFrame, *columns: str) -> DataFrame:
    """Results by row number (``row, component`` and ``columns`` of longs) for all rows of
    ``numbered``: components are named by their key, and rows without a result stand alone."""
    found = found.withColumnRenamed("row", "_row")
    named = rows.join(found, rows["row"] == found["_row"], "left").select(
        "row", key, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns],
        F.coalesce("component", "row").alias("component"))
    if plain:
        named = named.withColumn("component_id", F.col("component"))
    else:
        keys = rows.select(F.col("row").alias("component"), F.col(key).alias("component_id"))
        named = named.join(keys, "component")
    return named.select(
        key, *columns, "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))


def numbered_whole(docs: DataFrame) -> DataFrame:
    """``row, text`` and ``rest``, a struct of all columns but the text: see ``restored``."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return numbered(docs.select("doc_id", "text", rest.alias("rest")), "doc_id", "text", "rest")[0]


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in columns])


def packed(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` for narrow rows that a scan of wide ones leaves: in files of useful size, not
    one small file for each piece of the scan."""
    return materialise(df.hint("rebalance"), name)


#: Row numbers (8 bytes each) that may be sent to every task.
BROADCAST_ROWS = 500_000


def only(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose ``row`` is (``left_anti``: is not) in ``ids`` (distinct, written). Few ids are sent
    to the tasks, so that texts stay where they are; many are joined."""
    ids = ids.select("row")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return rows.join(ids, "row", how)


# ---- words as 64-bit hashes, many texts at once ------------------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_UNBASE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Texts are worked on in pieces of so many bytes, or one text if it is longer.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE * 2, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, _UNBASE)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def word_hashes(
    texts: list[bytes], apart: np.ndarray = _BLANK
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased (A-Z) texts, and where each text's words begin (one more
    entry than texts). ``apart`` tells which bytes stand between words, line feeds among them."""
    data = (b"\n".join(texts) + b"\n").lower()
    a = np.frombuffer(data, np.uint8)
    up, down = _powers_to(len(a))
    blank = apart[a]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return h, np.searchsorted(start, begin)


def pieces(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` bytes, one text at least."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def as_bytes(column) -> list[bytes]:
    """Values of an Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]
