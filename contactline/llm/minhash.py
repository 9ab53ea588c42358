"""Near-duplicate documents by b-bit MinHash.

Each text's distinct shingles are hashed; of the minima of HASHES hash functions, bands of ROWS whole
minima make candidate buckets, and the low BITS bits of each are packed into a signature. In a
bucket, candidates are compared with a pivot, never all with all: the share of equal signature
parts, corrected for chance collisions, leaves out pairs that are clearly apart, and the full
shingle sets confirm the rest. Texts with equal sets are one before that.

Connected components need no more links than those that join two components. So rounds of pivots go
on while a bucket holds several components, and what is then left, members of one bucket in
different components, is compared in blocks, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactline.llm.common import (
    BROADCAST_ROWS, as_bytes, mix, named, numbered, numbered_whole, only, packed, pieces, restored,
    word_hashes,
)
from contactline.llm.embeddings import forest
from contactline.llm.graph import components, written
from contactline.runtime import materialise

#: Hash functions: BANDS of ROWS. A pair at 0.8 shares no band with a chance of 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Low bits kept of each minimum, 16 parts to a long.
BITS = 4
#: Estimates may be this much too low (six standard deviations at 0.8).
SLACK = 0.2
#: Rounds of pivots before the blocks, and shingles and texts of a block, about.
ROUNDS, BLOCK, BLOCK_TEXTS = 2, 150_000, 256

_U = np.uint64
_rng = np.random.default_rng(97)
_MULTIPLIERS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | _U(1)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of a text's words; the whole sequence if it is shorter."""
    if not len(h):
        return h
    short = len(h) < size
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out + h[k : len(h) - size + 1 + k])
    return mix(out + _U(size)) if short else np.unique(out)


def _sets(texts: list[bytes], size: int) -> Iterator[list[np.ndarray]]:
    for a, b in pieces(texts):
        h, at = word_hashes(texts[a:b])
        yield [shingles(h[x:y], size) for x, y in zip(at[:-1], at[1:], strict=True)]


def _sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Set hashes (two), band keys and signatures of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    of_set = [np.add.reduceat(mix(flat ^ _U(k)), at) for k in (1, 2)]
    minima = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        minima[:, k] = np.minimum.reduceat(flat * _MULTIPLIERS[k], at)
    minima = mix(minima)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(ROWS):
        bands = mix(bands + minima[:, k::ROWS])
    parts = (minima & _U((1 << BITS) - 1)).reshape(len(sets), -1, 64 // BITS)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * _U(BITS)
    signature = np.bitwise_or.reduce(parts << shifts, axis=2)
    return of_set[0], of_set[1], bands, signature


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.reshape(-1)))


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """``row, n_shingles, s1, s2, bands, signature`` from ``row, text``."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, row = as_bytes(batch.column(1)), batch.column(0)
            first = 0
            for sets in _sets(texts, size):
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                s1, s2 = np.zeros((2, len(sets)), np.int64)
                bands = np.zeros((len(sets), BANDS), np.int64)
                signature = np.zeros((len(sets), HASHES * BITS // 64), np.int64)
                if len(some):
                    found = _sketch([sets[i] for i in some])
                    for whole, part in zip((s1, s2, bands, signature), found, strict=True):
                        whole[some] = part.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [row.slice(first, len(sets)), pa.array(n), pa.array(s1), pa.array(s2),
                     _lists(bands), _lists(signature)],
                    names=["row", "n_shingles", "s1", "s2", "bands", "signature"])
                first += len(sets)

    return rows.select("row", "text").mapInArrow(
        per_batch,
        "row long, n_shingles long, s1 long, s2 long, bands array<long>, signature array<long>")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """``row, shingles`` (sorted hashes) from ``row, text``."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, row = as_bytes(batch.column(1)), batch.column(0)
            first = 0
            for sets in _sets(texts, size):
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [row.slice(first, len(sets)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["row", "shingles"])
                first += len(sets)

    return rows.select("row", "text").mapInArrow(per_batch, "row long, shingles array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two sets by their signatures: equal parts, less those equal by chance."""
    mask = int("1" * (64 // BITS), 2 ** BITS if BITS != 4 else 16)

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(folded.bitwiseAND(F.lit(mask).cast("long")))

    n = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x.cast("int"))
    chance = 2.0**-BITS
    return (1.0 - n / HASHES - chance) / (1.0 - chance)


def _similar(common: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether 100 * intersection >= percent * union, in whole numbers."""
    return common * 100 >= (a + b - common) * percent


def _confirmed(
    pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, rows: int
) -> DataFrame:
    """Of pairs of rows ``u, v`` of the components ``a, b`` those that the full sets confirm, after
    a look at sizes and signatures: ``u, v``, the components."""
    sign = lambda c: nodes.select(
        F.col("row").alias(c), F.col("signature").alias(f"{c}_s"), F.col("n_shingles").alias(f"{c}_n"))
    sizes = F.least("u_n", "v_n") * 100 >= F.greatest("u_n", "v_n") * percent
    near = written(
        pairs.join(sign("u"), "u").join(sign("v"), "v")
        .where(sizes & (estimate(F.col("u_s"), F.col("v_s")) >= percent / 100 - SLACK))
        .select("u", "v", "a", "b", "u_n", "v_n"), "near", rows)
    wanted = near.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    own = only(sets, wanted)
    of = lambda c: own.select(F.col("row").alias(c), F.col("shingles").alias(f"{c}_x"))
    common = F.size(F.array_intersect("u_x", "v_x"))
    return materialise(
        near.join(of("u"), "u").join(of("v"), "v").where(
            _similar(common, F.col("u_n"), F.col("v_n"), percent))
        .select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, some columns at a time."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets),) * 2)
    width = 8192
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], column[a:b] - c] = 1
        total += has @ has.T
    return np.rint(total).astype(np.int64)


def _join_blocks(table: pa.Table, percent: int) -> pa.Table:
    """Links ``u, v`` between components that texts in a pair of blocks join, one tree each."""
    table = table.combine_chunks()
    row, comp = table.column("row").to_numpy(), table.column("component").to_numpy()
    lists = table.column("shingles").chunk(0)
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
    size = np.diff(ends)
    common = _common(sets)
    linked = common * 100 >= (size[:, None] + size[None, :] - common) * percent
    linked |= comp[:, None] == comp[None, :]
    to = comp[forest(linked)]
    new = to != comp
    edges = np.unique(np.stack([comp[new], to[new]], 1), axis=0)
    return pa.table({"u": edges[:, 0], "v": edges[:, 1]})


def _rest(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` between components that meet in a bucket. The members of a bucket's largest component meet
    all others, the others also each other, in blocks: every pair of blocks is a group."""
    of_comp = buckets.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = of_comp.groupBy("bucket").agg(
        F.max(F.struct("n", "component"))["component"].alias("largest"))
    placed = materialise(
        buckets.join(largest, "bucket").join(nodes.select("row", "n_shingles"), "row")
        .withColumn("other", F.col("component") != F.col("largest")), "placed")
    of = lambda other, what: F.sum(F.when(F.col("other") == other, what).otherwise(0))
    blocks = lambda other: F.ceil(F.greatest(
        of(other, F.col("n_shingles")) / BLOCK, of(other, F.lit(1)) / BLOCK_TEXTS)).cast("int")
    counted = placed.groupBy("bucket").agg(blocks(True).alias("others"), blocks(False).alias("same"))
    spot = F.xxhash64("row")
    block = F.when(F.col("other"), F.pmod(spot, "others")).otherwise(
        F.col("others") + F.pmod(spot, F.greatest("same", F.lit(1))))
    last = F.when(F.col("other"), F.col("others") + F.col("same")).otherwise(F.col("others")) - 1
    dealt = (
        placed.join(counted, "bucket").withColumn("block", block.cast("int"))
        .withColumn("meets", F.explode(F.sequence(F.lit(0), last)))
        .select("bucket", F.least("block", "meets").alias("i"), F.greatest("block", "meets").alias("j"),
                "row", "component")
    )
    return dealt.join(sets, "row").groupBy("bucket", "i", "j").applyInArrow(
        lambda table: _join_blocks(table, percent), "u long, v long")


def _buckets(classes: DataFrame) -> DataFrame:
    """``bucket, row`` of buckets with two members at least; of those with the same members one."""
    bands = classes.select("row", F.posexplode("bands").alias("band", "key")).select(
        "row", F.xxhash64("band", "key").alias("bucket"))
    shared = bands.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("row").alias("low"),
        F.sum(F.shiftright(F.xxhash64("row"), 24)).alias("mark"),
        F.sum(F.shiftright(F.xxhash64("row", F.lit(1)), 24)).alias("mark2")).where("n > 1")
    once = materialise(
        shared.groupBy("n", "low", "mark", "mark2").agg(F.min("bucket").alias("bucket"))
        .select("bucket"), "shared_buckets")
    if once.count() <= BROADCAST_ROWS:
        once = F.broadcast(once)
    return bands.join(once, "bucket", "left_semi").select("bucket", "row", F.col("row").alias("component"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``row, component`` after links between components."""
    joined = components(links).select(
        F.col("node").alias("component"), F.col("component").alias("_to"))
    return written(
        labels.join(joined, "component", "left").select(
            "row", F.coalesce("_to", "component").alias("component")), "labels", labels.count())


def _round(
    buckets: DataFrame, turn: int, labels: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """Compares each bucket's members with a pivot of another component; the pivot then leaves the
    bucket. In the first round each member tries the pivot that it meets most often, and the others
    only if that left them apart."""
    chosen = buckets.groupBy("bucket").agg(
        F.min(F.struct(F.xxhash64("row", F.lit(turn)).alias("h"), "row")).alias("p")
    ).select("bucket", F.col("p.row").alias("pivot"))
    rows = buckets.count()
    met = written(buckets.join(chosen, "bucket").where("row <> pivot"), "met", rows)
    pairs = written(met.groupBy("row", "pivot").agg(F.count("*").alias("n")), "pairs", rows)
    best = pairs.groupBy("row").agg(F.max(F.struct("n", "pivot"))["pivot"].alias("pivot"))
    for some in (best, pairs) if turn == 0 else (pairs,):
        at = lambda c, to: labels.select(F.col("row").alias(c), F.col("component").alias(to))  # noqa: E731,B023
        apart = some.join(at("row", "a"), "row").join(at("pivot", "b"), "pivot").where("a <> b")
        links = _confirmed(
            apart.select(F.col("row").alias("u"), F.col("pivot").alias("v"), "a", "b"), nodes, sets,
            percent, rows)
        if not links.isEmpty():
            labels = _merged(labels, links)
    left = met.drop("pivot", "component").join(labels, "row")
    several = left.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return written(
        left.join(several.select("bucket"), "bucket", "left_semi"), "buckets", rows), labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``doc_id, text``.

    Words are lower-cased (A-Z) runs without ASCII white space; a text with fewer words than ``size``
    is one shingle. Two texts are linked if their sets have 100 * intersection >= percent * union.
    Null, empty and blank texts have no shingles and are linked with nothing; rows that repeat a
    doc_id, or have none, are documents of their own, and a component is named by its smallest
    doc_id. An empty table gives no rows.
    """
    rows, plain = numbered(docs, "doc_id", "text")
    found = near_components(rows, size, percent)
    return named(rows.select("row", "doc_id"), plain, "doc_id", found, "n_shingles")


def near_components(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """``row, n_shingles, component`` (a row) from ``row, text`` with unique rows."""
    sketch = packed(sketches(rows, size), "sketches")
    same = ["s1", "s2", "n_shingles"]
    classes = materialise(
        sketch.where("n_shingles > 0").groupBy(*same).agg(
            F.min(F.struct("row", "bands", "signature")).alias("x"))
        .select(*same, "x.row", "x.bands", "x.signature"), "classes")
    nodes = classes.select("row", "signature", "n_shingles")
    buckets = materialise(_buckets(classes), "buckets")
    wanted = materialise(buckets.select("row").distinct(), "ids")
    sets = materialise(shingle_sets(only(rows, wanted), size), "sets")
    labels = wanted.select("row", F.col("row").alias("component"))
    for turn in range(ROUNDS):
        if buckets.isEmpty():
            break
        buckets, labels = _round(buckets, turn, labels, nodes, sets, percent)
    if not buckets.isEmpty():
        labels = _merged(labels, materialise(_rest(buckets, nodes, sets, percent), "links"))
    of_class = materialise(
        classes.join(labels, "row", "left").select(
            *same, F.coalesce("component", "row").alias("component")), "class_components")
    return sketch.select("row", *same).join(of_class, same, "left").select(
        "row", "n_shingles", "component")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one document of each component: that of the smallest doc_id."""
    rows = numbered_whole(docs)
    others = near_components(rows, size, percent).where("row <> component").select("row")
    return restored(only(rows, materialise(others, "copies"), "left_anti"), docs.columns)
