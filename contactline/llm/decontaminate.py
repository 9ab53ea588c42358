"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet where they share a seed, a run of SHORTEST words, that is one of the
item's rarest: so many that a document without them cannot cover the item. For each such pair, tiles are
laid: the longest common runs of words that no tile covers yet are found with running
Karp-Rabin hashes and marked, again and again, down to SHORTEST words. The share of an item's words
under tiles does not depend on their order, so passages whose parts are moved are found as well.

A word is a run of letters, digits and characters beyond ASCII; A-Z are lower-cased.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactline.llm.common import (
    as_bytes, mix, numbered, numbered_whole, only, packed, pieces, restored, word_hashes,
)
from contactline.runtime import materialise

#: Words of a seed and of the shortest tile.
SHORTEST = 5
#: Bits of the filter of seeds that is sent to the tasks, whatever the benchmark's size. It only
#: leaves out words that cannot be part of a tile.
FILTER_BITS = 1 << 22
#: Length at which the search for tiles begins.
FIRST = 20

_U = np.uint64
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def seeds(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of SHORTEST words, by first word, and which of them lie in one text."""
    n = len(h) - SHORTEST + 1
    if n <= 0:
        return h[:0], np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    for k in range(SHORTEST):
        out = mix(out + h[k : n + k])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return out, text[:n] == text[SHORTEST - 1 :]


def _items(benchmark: DataFrame) -> DataFrame:
    """``item, n, words`` and ``seeds`` (by first word) of each item."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = word_hashes(as_bytes(batch.column(1)), _APART)
            s, whole = seeds(h, at)
            words = [h[a:b].view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
            runs = [s[a : max(a, b - SHORTEST + 1)].view(np.int64)
                    for a, b in zip(at[:-1], at[1:], strict=True)]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(words, kind), pa.array(runs, kind)],
                names=["item", "n", "words", "seeds"])

    return benchmark.select("row", "text").mapInArrow(
        per_batch, "item long, n long, words array<long>, seeds array<long>")


def _stretches(rows: DataFrame, marks: bytes) -> DataFrame:
    """``row, words, seeds``: of each document the seeds that the filter lets through and the words
    under them, each once, with 0 between stretches that do not adjoin. Documents without any are left
    out."""

    def of(h: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        bits = np.frombuffer(marks, np.uint8)
        s, whole = seeds(h, at)
        bit = (s % _U(FILTER_BITS)).astype(np.int64)
        hit = whole & ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1)
        first = np.flatnonzero(hit)
        doc = np.searchsorted(at, first, "right") - 1
        out: tuple[list, list, list] = ([], [], [])
        for d in np.unique(doc):
            f = first[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
            parts = np.split(f, np.flatnonzero(np.diff(f) > SHORTEST) + 1)
            words = []
            for p in parts:
                words += [h[p[0] : p[-1] + SHORTEST], np.zeros(1, np.uint64)]
            out[0].append(numbers[d])
            out[1].append(np.concatenate(words).view(np.int64))
            out[2].append(np.unique(s[f]).view(np.int64))
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], kind)],
            names=["row", "words", "seeds"])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts = batch.column(0).to_numpy(), as_bytes(batch.column(1))
            for a, b in pieces(texts):
                yield of(*word_hashes(texts[a:b], _APART), numbers[a:b])

    return rows.select("row", "text").mapInArrow(
        per_batch, "row long, words array<long>, seeds array<long>")


def _windows(words: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Running Karp-Rabin hashes of the windows that no tile touches: place and hash."""
    base, modulus = 1_000_003, (1 << 61) - 1
    top = pow(base, length, modulus)
    value = run = 0
    for i, w in enumerate(words):
        if not free[i] or not w:
            value = run = 0
            continue
        value = (value * base + w) % modulus
        run += 1
        if run > length:
            value = (value - words[i - length] * top) % modulus
        if run >= length:
            yield i - length + 1, value


def tiles(pattern: list[int], text: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``place in pattern, place in text, length``. 0 matches nothing. Of
    tiles of one length the first in the pattern, then in the text, is laid first."""
    free_p, free_t = [bool(w) for w in pattern], [bool(w) for w in text]
    laid: list[tuple[int, int, int]] = []
    length = max(shortest, min(FIRST, len(pattern)))
    while True:
        places = defaultdict(list)
        for t, value in _windows(text, free_t, length):
            places[value].append(t)
        found = []
        for p, value in _windows(pattern, free_p, length):
            for t in places.get(value, ()):
                if p and t and free_p[p - 1] and free_t[t - 1] and pattern[p - 1] == text[t - 1]:
                    continue  # part of a longer one
                k = 0
                while (p + k < len(pattern) and t + k < len(text) and free_p[p + k]
                       and free_t[t + k] and pattern[p + k] == text[t + k]):
                    k += 1
                if k >= length:
                    found.append((-k, p, t))
        found.sort()
        again = False
        for k, p, t in found:
            k = -k
            if all(free_p[p : p + k]) and all(free_t[t : t + k]):
                free_p[p : p + k] = free_t[t : t + k] = [False] * k
                laid.append((p, t, k))
            else:
                again = True  # what is left of it may be long enough
        if not again:
            if length == shortest:
                return laid
            length = max(shortest, length // 2)


def _tiled(pairs: DataFrame, least: float) -> DataFrame:
    """``row, item, n_tiles, covered, n`` of pairs with the words and seeds of both. No more of an item
    can be tiled than lies under shared seeds, so pairs with too few of these are left out at once."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            low = (1 << 61) - 2
            for row, item, n, item_words, item_seeds, words, held in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                shared = np.flatnonzero(np.isin(item_seeds, held))
                if _under(shared, n).sum() < least * n:
                    continue
                laid = tiles([w % low + 1 for w in item_words], [w and w % low + 1 for w in words])
                out.append((row, item, len(laid), sum(x[2] for x in laid), n))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["row", "item", "n_tiles", "covered", "n"])

    return pairs.select("row", "item", "n", "item_words", "item_seeds", "words", "seeds").mapInArrow(
        per_batch, "row long, item long, n_tiles long, covered long, n long")


def _under(first: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie under seeds that begin at some places."""
    edges = np.zeros(n + SHORTEST, np.int64)
    edges[first] += 1
    edges[first + SHORTEST] -= 1
    return np.cumsum(edges)[:n] > 0


def needed(places: np.ndarray, held: np.ndarray, counts: np.ndarray, n: int, least: float) -> np.ndarray:
    """The rarest seeds of an item, of which a document with ``least`` of its words has one at least:
    those left once the most frequent ones, as many as cover less than that, are put aside.

    ``places``, ``held`` and ``counts`` are the place, the seed and its number of documents."""
    order = np.lexsort((held, -counts))
    seeds_, first = np.unique(held[order], return_index=True)
    seeds_ = seeds_[np.argsort(first)]  # the most frequent first
    aside = np.zeros(n, bool)
    for k, s in enumerate(seeds_):
        for p in places[held == s]:
            aside[p : p + SHORTEST] = True
        if aside.sum() >= least * n:
            return seeds_[k:]
    return seeds_[:0]


def _needed(items: DataFrame, least: float) -> DataFrame:
    """``item, seed`` from ``item, n, found``, the places, seeds and document counts of each item."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for item, n, *found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, held, counts = (np.array(f, np.int64) for f in found)
                rare = needed(places, held, counts, n, least).tolist()
                out[0].extend([item] * len(rare))
                out[1].extend(rare)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], names=["item", "seed"])

    return items.select("item", "n", "found.at", "found.seed", "found.docs").mapInArrow(
        per_batch, "item long, seed long")


def _marks(seeds_: DataFrame) -> bytes:
    """The filter's bits; what the tasks send back is its words, FILTER_BITS / 64 at most."""
    bit = F.pmod("seed", F.lit(FILTER_BITS))
    one = F.expr(f"shiftleft(1L, cast(pmod(seed, {FILTER_BITS}L) & 63 AS int))")
    words = seeds_.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    marks = np.zeros(FILTER_BITS // 64, np.int64)
    marks[[r["word"] for r in words]] = [r["bits"] for r in words]
    return marks.astype("<i8").tobytes()


def tilings(rows: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """``row, item, n_tiles, covered, n`` of all pairs with at least ``least`` of the item covered;
    ``rows`` and ``items`` have unique ``row`` and ``text``.

    Documents meet items by the items' rarest seeds only (see ``needed``), so a phrase that many of
    both have brings no pairs about.
    """
    items = materialise(_items(items), "items")
    of_items = items.select("item", "n", F.posexplode("seeds").alias("at", "seed"))
    found = packed(_stretches(rows, _marks(of_items)), "stretches")
    # A seed of each item is taken once; those that no document has take no part.
    met = found.select("row", F.explode("seeds").alias("seed"))
    counts = met.groupBy("seed").agg(F.count("*").alias("docs"))
    known = of_items.join(counts, "seed").groupBy("item", "n").agg(
        F.collect_list(F.struct("at", "seed", "docs")).alias("found"))
    rare = materialise(_needed(known, least), "rare_seeds")
    pairs = materialise(met.join(rare, "seed").select("row", "item").distinct(), "pairs")
    words = items.select(
        "item", "n", F.col("words").alias("item_words"), F.col("seeds").alias("item_seeds"))
    joined = pairs.join(found, "row").join(words, "item")
    tiled = _tiled(joined, least)
    return materialise(tiled.where(F.col("covered") >= least * F.col("n")), "tilings")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.6) -> DataFrame:
    """``doc_id, item_id, n_tiles, covered_words, item_words, coverage``: documents (``doc_id,
    text``) that hold at least ``least`` of the words of a benchmark item (``item_id, text``).

    Items below SHORTEST words, null and empty texts match nothing; rows that repeat an id, or have
    none, are compared like others. Empty tables give no rows.
    """
    rows, _ = numbered(docs, "doc_id", "text")
    items, _ = numbered(benchmark, "item_id", "text")
    found = tilings(rows, items, least)
    return (
        found.join(rows.select("row", "doc_id"), "row")
        .join(items.select(F.col("row").alias("item"), "item_id"), "item")
        .select(
            "doc_id", "item_id", "n_tiles", F.col("covered").alias("covered_words"),
            F.col("n").alias("item_words"), (F.col("covered") / F.col("n")).alias("coverage"))
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.6) -> DataFrame:
    """``docs``, all columns, without the documents that ``contaminated`` finds."""
    rows = numbered_whole(docs)
    items, _ = numbered(benchmark, "item_id", "text")
    leaks = materialise(tilings(rows, items, least).select("row").distinct(), "leaks")
    return restored(only(rows, leaks, "left_anti"), docs.columns)
