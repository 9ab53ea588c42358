"""Near-duplicate vectors: an exact metric range join.

On unit vectors, cosine >= c means distance <= eps = sqrt(2 - 2c). Each vector belongs to the cell of
its nearest pivot. If x and y are at most eps apart and y lies in cell B, then by the triangle
inequality x is at most 2 eps farther from pivot B than from its own, and its distance from the plane
between the two pivots is at most eps; vectors within both bounds are copied to cell B, so each cell
can be joined by itself, and the join misses nothing, whatever the pivots are. Cells are cut into
blocks of bounded size, so that a cell may hold any part of all vectors.

Equal vectors are one before the join. Inside a pair of blocks only counts per vector and a spanning
forest of the links are made, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from contactline.llm.common import named, numbered
from contactline.llm.graph import components
from contactline.operators.skew import hot_key_left_join
from contactline.runtime import materialise

#: Vectors of a block, about.
BLOCK = 1024
#: Most pivots, and vectors of the sample from which pivots and their number are taken. The choice
#: decides how much is copied, never what is found.
MOST_PIVOTS, SAMPLE = 512, 2000
#: More than rounding adds to or takes from a squared distance of unit vectors. Pivots are farther
#: apart than that.
ROUNDING = 1e-9


def _vectors(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    ends = ends.astype(np.int64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def unit_of(v: np.ndarray) -> np.ndarray:
    if not 1e-100 < (top := abs(v).max()) < 1e100:
        v = v / top
    return v / np.sqrt(v @ v)


def _reach(x: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors the nearest pivot, and a matrix of the cells before it that they go to too."""
    d2 = np.maximum(2 - 2 * (x @ pivots.T), 0)
    d = np.sqrt(d2)
    own = np.argmin(d, axis=1)
    at = np.arange(len(x))
    # Both bounds are wider than rounding can make them, and neither divides by a distance, so
    # they hold for pivots that point the same way too.
    eps = np.sqrt(eps * eps + ROUNDING)
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0) + ROUNDING)[own]
    near = d <= (d[at, own] + 2 * eps + np.sqrt(ROUNDING))[:, None]
    near &= d2 - d2[at, own][:, None] <= 2 * apart * eps + ROUNDING
    return own, near & (np.arange(len(pivots)) < own[:, None])


def _ways(sample: np.ndarray) -> np.ndarray:
    """The first MOST_PIVOTS unit vectors that point another way than those before them."""
    kept = np.empty((min(MOST_PIVOTS, len(sample)), sample.shape[1]))
    n = 0
    for v in sample:
        if n == len(kept):
            break
        if (2 - 2 * (kept[:n] @ v) > ROUNDING).all():
            kept[n] = v
            n += 1
    return kept[:n]


def _pivots(distinct: DataFrame, n: int, labels: int, eps: float) -> dict[int, np.ndarray]:
    """Pivots by dimension, from a sample chosen by a hash: so many that the fewest copies of
    vectors are dealt out, as estimated on the sample."""
    share = max(1, n // SAMPLE)
    chosen = distinct.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).orderBy("row").limit(
        2 * SAMPLE)
    found: dict[int, list] = {}
    for r in chosen.select("embedding").collect():
        v = np.asarray(r["embedding"], float)
        found.setdefault(len(v), []).append(unit_of(v))
    best = {}
    for dim, sample in found.items():
        x = np.stack(sample)
        ways = _ways(x)
        scale = n / max(1, sum(map(len, found.values()))) / max(1, labels)
        costs = {}
        many = 1
        while many <= len(ways):
            own, near = _reach(x, ways[:many], eps)
            core = np.bincount(own, minlength=many) * scale
            copies = near.sum(0) * scale
            core_blocks, copy_blocks = np.ceil(core / BLOCK), np.ceil(copies / BLOCK)
            costs[many] = float(np.sum(core * (core_blocks + copy_blocks) + copies * core_blocks))
            many *= 2
        best[dim] = ways[: min(costs, key=costs.get)]
    return best


def _cells(distinct: DataFrame, pivots: dict[int, np.ndarray], eps: float) -> DataFrame:
    """``label, dim, cell, own, row, n, unit`` (bytes of doubles): each vector in its own cell and
    in the cells before it that hold vectors it may be linked with."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                yield _dealt(whole.slice(first, 1024), pivots, eps)

    return distinct.select("label", "row", "n", "embedding").mapInArrow(
        per_batch,
        "label long, dim int, cell int, own boolean, row long, n long, unit binary")


def _dealt(batch: pa.RecordBatch, pivots: dict[int, np.ndarray], eps: float) -> pa.RecordBatch:
    vectors = [unit_of(v) for v in _vectors(batch.column("embedding"))]
    dims = np.array([len(v) for v in vectors], np.int64)
    at, cell = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    copies = [(at[:0], at[:0])]
    for dim in np.unique(dims):
        if dim in pivots:
            some = np.flatnonzero(dims == dim)
            own, near = _reach(np.stack([vectors[i] for i in some]), pivots[dim], eps)
            cell[some] = own
            i, c = np.nonzero(near)
            copies.append((some[i], c))
    of = np.concatenate([at, *(c[0] for c in copies)])
    cells = np.concatenate([cell, *(c[1] for c in copies)])
    take = pa.array(of)
    return pa.RecordBatch.from_arrays(
        [batch.column("label").take(take), pa.array(dims[of], pa.int32()), pa.array(cells, pa.int32()),
         pa.array(np.arange(len(of)) < len(at)), batch.column("row").take(take),
         batch.column("n").take(take), pa.array([vectors[i].tobytes() for i in of], pa.binary())],
        names=["label", "dim", "cell", "own", "row", "n", "unit"])


def forest(links: np.ndarray) -> np.ndarray:
    """Of each node the smallest node that it reaches, in a symmetric matrix of links."""
    n = len(links)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(links, label, n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _join_blocks(table: pa.Table, cosine: float) -> pa.Table:
    """Two blocks of a cell to ``row, n_links, linked``: links of a vector inside the pair of blocks
    (copies counted) and the vector that stands for its tree there."""
    get = lambda c: table.column(c).to_numpy()
    row, n, own = get("row"), get("n"), get("own")
    unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(row), -1)
    first = get("block") == get("i")
    second = get("block") == get("j")  # the same rows, if a block is joined with itself
    x, y = np.flatnonzero(first), np.flatnonzero(second)
    if not len(x) or not len(y):
        return pa.table({"row": row[:0], "n_links": n[:0], "linked": row[:0]})
    # A link between cells is made in the lower cell, where one end is a copy.
    hit = (unit[x] @ unit[y].T >= cosine) & (own[x][:, None] | own[y][None, :])
    linked = np.zeros((len(row),) * 2, bool)
    linked[np.ix_(x, y)] = hit
    linked |= linked.T
    np.fill_diagonal(linked, False)
    count = linked @ n
    order = np.argsort(row, kind="stable")
    tree = np.empty(len(row), np.int64)
    tree[order] = row[order][forest(linked[np.ix_(order, order)])]
    some = count > 0
    return pa.table({"row": row[some], "n_links": count[some], "linked": tree[some]})


def _numbered_labels(usable: DataFrame) -> DataFrame:
    """Labels as longs: whole numbers as they are, others as the smallest row that has them."""
    if isinstance(usable.schema["label"].dataType, IntegralType):
        return usable.withColumn("label", F.col("label").cast("long"))
    usable = materialise(usable, "labelled_vectors")
    numbers = usable.groupBy("label").agg(F.min("row").alias("_number"))
    return hot_key_left_join(usable, numbers, ["label"], ["row"]).select(
        "row", F.col("_number").alias("label"), "embedding")


def link(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vec_id, embedding, label``.

    Two vectors are linked if their labels are equal and not null, their dimensions are equal, and
    their cosine in double precision is at least ``cosine`` (above 0). Labels may be of any type that
    can be grouped. Vectors that are null, empty
    or zero or hold null or non-finite components are linked with nothing. Rows that repeat a
    vec_id, or have none, are vectors of their own; a component is named by its smallest vec_id.
    """
    rows, plain = numbered(vectors, "vec_id", "embedding", "label")
    good = F.col("label").isNotNull() & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ) & F.exists("embedding", lambda c: c != 0)
    doubles = F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    usable = rows.where(F.coalesce(good, F.lit(False))).select(
        "row", "label", doubles.alias("embedding"))
    members = materialise(_numbered_labels(usable), "vectors")
    distinct = materialise(
        members.groupBy("label", "embedding").agg(
            F.min("row").alias("row"), F.count("*").alias("n")), "distinct_vectors")
    size = distinct.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    eps = float(np.sqrt(2 - 2 * cosine))
    pivots = _pivots(distinct, size["n"], size["labels"], eps)
    cells = materialise(_cells(distinct, pivots, eps), "cells")

    cell = ["label", "dim", "cell"]
    blocks = lambda own: F.ceil(F.count(F.when(F.col("own") == own, 1)) / BLOCK).cast("int")
    blocks_of = cells.groupBy(*cell).agg(
        blocks(True).alias("cores"), blocks(False).alias("copies")).where("cores > 0")
    # Pairs of blocks of a cell are the groups: its own vectors meet all, copies only those.
    spot = F.xxhash64("row")
    block = F.when(F.col("own"), F.pmod(spot, "cores")).otherwise(
        F.col("cores") + F.pmod(spot, F.greatest("copies", F.lit(1))))
    last = F.when(F.col("own"), F.col("cores") + F.col("copies")).otherwise(F.col("cores")) - 1
    placed = (
        cells.join(blocks_of, cell)
        .withColumn("block", block.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select(*cell, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", "row", "n", "own", "unit")
    )
    found = materialise(
        placed.groupBy(*cell, "i", "j").applyInArrow(
            lambda table: _join_blocks(table, cosine), "row long, n_links long, linked long"),
        "found")

    in_links = found.groupBy("row").agg(F.sum("n_links").alias("_others"))
    comps = components(
        found.where("row <> linked").select(F.col("row").alias("u"), F.col("linked").alias("v")))
    classes = (
        distinct.join(in_links, "row", "left")
        .join(comps.select(F.col("node").alias("row"), "component"), "row", "left")
        .select(
            F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
            (F.col("n") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "row").alias("component"))
    )
    linked = members.join(
        classes, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))
    ).select("row", "n_links", "component")
    return named(rows, plain, "vec_id", linked, "n_links")


#: DuckDB SQL for the rows of ``link`` over ``embeddings``: all pairs, and a walk along the links.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v
      WHERE label IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.norm > 0 AND b.norm > 0
        AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM v
  UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id AND r.c < l.y),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
c AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN c ON v.vec_id = c.vec_id LEFT JOIN n ON n.x = v.vec_id"""
