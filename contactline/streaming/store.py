"""A table kept by key, of which a batch touches only the ranges that its keys lie in.

Keys are dealt to ranges by hash. A batch appends one part to each range it touches; a range with many
parts is rewritten as one, and when ranges grow too long their number is doubled. Which parts a range
has is written as a manifest, one for each version, after its parts: readers take the last whole one,
so that a version is there as a whole or not at all, and a batch that is repeated replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "range int, parts array<long>, rows long, ranges int"


@dataclass
class _Version:
    number: int
    ranges: int
    parts: dict[int, list[int]] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)

    def files(self) -> set[tuple[int, int]]:
        return {(p, r) for r, parts in self.parts.items() for p in parts}


class KeyedTable:
    """``newest``: of rows that share a key only those of the last batch count; else all rows do."""

    def __init__(
        self, spark: SparkSession, folder: str, key: str = "site_key", newest: bool = False,
        ranges: int = 64, most_parts: int = 8, most_rows: int = 200_000,
    ):
        self.spark, self.folder, self.key, self.newest = spark, folder, key, newest
        self.first_ranges, self.most_parts, self.most_rows = ranges, most_parts, most_rows

    # ---- versions

    def _versions(self) -> list[int]:
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/v=*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marks)
        return sorted(int(m.getPath().getParent().getName()[2:]) for m in found or [])

    def _load(self, number: int) -> _Version:
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/v={number}").collect()
        ranges = rows[0]["ranges"] if rows else self.first_ranges
        known = [r for r in rows if r["range"] is not None]
        return _Version(number, ranges, {r["range"]: list(r["parts"]) for r in known},
                        {r["range"]: r["rows"] for r in known})

    def version(self) -> int:
        """Number of the last batch that is in the table; -1 if there is none."""
        return max(self._versions(), default=-1)

    def _current(self) -> _Version:
        number = self.version()
        return self._load(number) if number >= 0 else _Version(-1, self.first_ranges)

    # ---- reading

    def _range(self, ranges: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(ranges)).cast("int")

    def _read(self, version: _Version, ranges: list[int] | None = None) -> DataFrame | None:
        some = version.parts if ranges is None else {r: version.parts.get(r, []) for r in ranges}
        paths = [f"{self.folder}/data/part={p}/range={r}" for r, parts in some.items() for p in parts]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/data").parquet(*paths)
        if not self.newest:
            return rows.drop("part", "range")
        names = [c for c in rows.columns if c not in (self.key, "part", "range")]
        last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), "part").alias("_r")
        return rows.groupBy(self.key).agg(last).select(self.key, "_r.*")

    def read(self) -> DataFrame | None:
        """All rows; None before the first batch."""
        return self._read(self._current())

    def read_keys(self, keys: DataFrame) -> DataFrame | None:
        """Rows of some keys (distinct). Only the ranges that these lie in are read."""
        version = self._current()
        ranges = keys.select(self._range(version.ranges).alias("r")).distinct().collect()
        rows = self._read(version, [r["r"] for r in ranges])
        return None if rows is None else rows.join(keys.select(self.key), self.key, "left_semi")

    # ---- writing

    def _write(self, rows: DataFrame, part: int, ranges: int) -> dict[int, int]:
        """Writes a part; its rows by range."""
        path = f"{self.folder}/data/part={part}"
        placed = rows.withColumn("range", self._range(ranges))
        placed.repartition("range").write.mode("overwrite").partitionBy("range").parquet(path)
        try:
            written = self.spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # no rows, no files
                return {}
            raise
        return {r["range"]: r["count"] for r in written.groupBy("range").count().collect()}

    def add(self, number: int, rows: DataFrame) -> None:
        """Adds the rows of a batch. Batches have rising numbers; one that comes again replaces
        itself."""
        earlier = [v for v in self._versions() if v < number]
        new = self._load(earlier[-1]) if earlier else _Version(-1, self.first_ranges)
        new.number = number
        for r, n in self._write(rows, 2 * number, new.ranges).items():
            new.parts.setdefault(r, []).append(2 * number)
            new.rows[r] = new.rows.get(r, 0) + n
        if sum(new.rows.values()) > new.ranges * self.most_rows:
            whole, ranges = self._read(new), new.ranges
            while sum(new.rows.values()) > ranges * self.most_rows // 2:
                ranges *= 2
            new = _Version(number, ranges)
            self._rewritten(new, whole)
        else:
            long = [r for r, parts in new.parts.items() if len(parts) > self.most_parts]
            if long:
                self._rewritten(new, self._read(new, long))
        table = [(r, p, new.rows[r], new.ranges) for r, p in sorted(new.parts.items())]
        self.spark.createDataFrame(table or [(None, None, None, new.ranges)], _MANIFEST).coalesce(
            1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={number}")
        self._forget(earlier, new)

    def _rewritten(self, version: _Version, rows: DataFrame) -> None:
        part = 2 * version.number + 1
        for r, n in self._write(rows, part, version.ranges).items():
            version.parts[r], version.rows[r] = [part], n

    def _forget(self, earlier: list[int], new: _Version) -> None:
        """Removes what neither this version nor the one before it has: readers may still be at that."""
        if len(earlier) < 2:
            return
        before = self._load(earlier[-1])
        kept = new.files() | before.files()
        for number in earlier[:-1]:
            for p, r in self._load(number).files() - kept:
                self._remove(f"data/part={p}/range={r}")
            self._remove(f"manifest/v={number}")

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
