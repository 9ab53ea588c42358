"""Repeated passages by suffix arrays built with two-stage sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus. No suffix
array holds a whole corpus, so the work is cut by content first: among the GRAM-byte strings of each
window of LENGTH bytes, the one with the least hash is its anchor. Equal windows have equal anchors,
so windows can only repeat where anchors do. Neighbouring windows with the same anchor are one
segment; of equal segments all but the first repeat as a whole, which settles nearly everything.
Different segments with the same anchor (where repeated passages begin and end) are joined into one
text per group of anchors, whose suffix array and common prefixes give the rest: suffixes smaller
than their successors are sorted directly, the others induced from them bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactline.llm.common import (
    BROADCAST_ROWS, as_bytes, mix, numbered, numbered_whole, pieces, restored,
)
from contactline.runtime import materialise

#: Bytes of a repeated string, and of an anchor.
LENGTH, GRAM = 100, 32
#: One text in so many is looked at to learn how many anchors there are and which are hot, and of
#: texts above LONG bytes one stretch of STRETCH bytes in so many. This only decides how the work is
#: dealt out.
SAMPLED, LONG, STRETCH = 64, 1 << 14, 1 << 12
#: Anchors, and segments, that a group holds, about; anchors above the first number are hot, and so
#: many of them may be sent to every task.
ANCHORS, SEGMENTS, MOST_HOT = 250_000, 8_000, 500_000
#: Segments that a task holds before it deals them out.
HELD = 200_000

_U = np.uint64
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTORS = np.random.default_rng(12).integers(1, 1 << 63, 8, dtype=np.uint64) | _U(1)
_PLACE = _U((1 << 31) - 1)

Found = tuple[np.ndarray, ...]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of GRAM bytes."""
    h = _BYTE[data]
    step = 1
    for f in _FACTORS[: GRAM.bit_length() - 1]:
        h = h[:-step] * f + h[step:]
        step *= 2
    return mix(h)


def segments(texts: list[bytes]) -> Found:
    """``anchor, content, text, at, n``: hash of the anchor, hash of the segment, number of the text,
    first window and number of windows; each window of each text is in one segment."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(size.sum())
    if total < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = _grams(data)
    # The least hash of each window and its place, the first of equals.
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    place = (least & _PLACE).astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, np.maximum(start, end - LENGTH + 1), 1)
    np.add.at(edge, end, -1)
    inside = np.cumsum(edge)[: len(place)] == 0  # windows that end in the text where they begin
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    last = np.ones(len(place), bool)
    last[:-1] = new[1:] | ~inside[1:]
    lo, hi = np.flatnonzero(inside & new), np.flatnonzero(inside & last)
    tail = hi + LENGTH - GRAM
    content = (hi - lo).astype(np.uint64)
    for k in range(0, 2 * LENGTH - GRAM, GRAM):
        content = mix(content * _FACTORS[6] + h[np.minimum(lo + k, tail)])
    text = np.searchsorted(start, lo, "right") - 1
    return h[place[lo]], content, text, lo - start[text], hi - lo + 1


def _split_first(key: np.ndarray, anchor, content, row, at) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first occurrence of each segment, and of the others."""
    order = np.lexsort((at, row, key))
    a, c = anchor[order], content[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    r, t = row[order], at[order]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (r != r[head]) | (t != t[head]) if len(order) else new
    return order[new], order[later]


def _runs(row: np.ndarray, at: np.ndarray, n: np.ndarray) -> Found:
    """Adjoining windows of a text made one run."""
    order = np.lexsort((at, row))
    row, at, n = row[order], at[order], n[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + n[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    return row[first], at[first], at[last] + n[last] - at[first]


def _occurrences(rows: DataFrame, groups: int, hot: np.ndarray) -> DataFrame:
    """Segments dealt out by anchor (hot ones by content too): a row for each group that a task has
    found some of, after equal segments of the task have been put together. The later ones of these
    are repeats at once (``again``)."""

    def dealt(parts: list[Found]) -> Iterator[pa.RecordBatch]:
        anchor, content, row, at, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        first, later = _split_first(mix(anchor) ^ content, anchor, content, row, at)
        again = _runs(row[later], at[later], n[later])
        key = anchor[first].copy()
        at_hot = np.isin(key, hot)
        key[at_hot] = mix(key[at_hot] ^ content[first][at_hot])
        group = (mix(key) % _U(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        first, group = first[order], group[order]
        ids, begin = np.unique(group, return_index=True)
        ends = pa.array(np.append(begin, len(group)), pa.int32())
        lists = [
            pa.ListArray.from_arrays(ends, pa.array(v[first].view(np.int64) if v.dtype == np.uint64
                                                    else v[first].astype(kind)))
            for v, kind in ((anchor, None), (content, None), (row, np.int64), (at, np.int32), (n, np.int16))
        ]
        if len(ids):
            yield _batch(ids, lists, None)
        if len(again[0]):
            yield _batch(mix(again[0].view(np.uint64)) % _U(groups), None, again)

    def _batch(ids, lists, again) -> pa.RecordBatch:
        ids = np.asarray(ids).astype(np.int64)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16()]
        if lists is None:
            lists = [pa.nulls(len(ids), pa.list_(k)) for k in kinds]
            again = [pa.array(a.astype(np.int64)) for a in again]
        else:
            again = [pa.nulls(len(ids), pa.int64()) for _ in range(3)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), *lists, *again],
            names=["group", "anchor", "content", "row", "at", "n", "again", "again_at", "again_n"])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Found] = []
        many = 0
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            texts = as_bytes(batch.column(1))
            for a, b in pieces(texts):
                anchor, content, text, at, n = segments(texts[a:b])
                held.append((anchor, content, numbers[a:b][text], at, n))
                many += len(anchor)
                if many > HELD:
                    yield from dealt(held)
                    held, many = [], 0
        if many:
            yield from dealt(held)

    return rows.select("row", "text").mapInArrow(
        per_task,
        "group long, anchor array<long>, content array<long>, row array<long>, at array<int>, "
        "n array<short>, again long, again_at long, again_n long")


def _load(rows: DataFrame) -> tuple[int, np.ndarray]:
    """About how many anchors there are, and which of them are hot, from one text in SAMPLED and
    one stretch in SAMPLED of each long text."""
    rate, long, stretch = SAMPLED, LONG, STRETCH

    def looked_at(row: int, text: bytes) -> list[bytes]:
        if len(text) <= long:
            return [text]
        k = np.arange(-(-len(text) // stretch), dtype=np.uint64)
        some = np.flatnonzero(mix(mix(k + _U(1)) ^ _U(row % (1 << 64))) % _U(rate) == 0)
        return [text[x * stretch : (x + 1) * stretch + LENGTH - 1] for x in some]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)
            texts = [t for row, text in whole for t in looked_at(row, text)]
            for a, b in pieces(texts):
                ids, times = np.unique(segments(texts[a:b])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.view(np.int64)), pa.array(times)], names=["anchor", "n"])

    sample = rows.where(
        (F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0) | (F.octet_length("text") > LONG)
    ).select("row", "text")
    counts = materialise(
        sample.mapInArrow(per_batch, "anchor long, n long").groupBy("anchor").agg(
            F.sum("n").alias("n")), "anchor_counts")
    total = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) * SAMPLED
    most = max(ANCHORS // 4, total // MOST_HOT) / SAMPLED
    hot = [r["anchor"] for r in counts.where(F.col("n") > most).select("anchor").collect()]
    return total, np.array(hot, np.int64).view(np.uint64)


def _settle(table: pa.Table, hot: np.ndarray) -> pa.Table:
    """One group: repeats (``kind`` 0), and first segments that share an anchor with another (1), or
    whose anchor is hot (2)."""
    get = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
    anchor, content = get("anchor").view(np.uint64), get("content").view(np.uint64)
    row, at, n = get("row"), get("at").astype(np.int64), get("n").astype(np.int64)
    first, later = _split_first(mix(anchor) ^ content, anchor, content, row, at)
    again = table.select(["again", "again_at", "again_n"]).filter(table.column("again").is_valid())
    out = [(0, np.zeros(len(again), np.int64), *(c.to_numpy() for c in again.columns))]
    run = _runs(row[later], at[later], n[later])
    out.append((0, np.zeros(len(run[0]), np.int64), *run))
    ids, where, times = np.unique(anchor[first], return_inverse=True, return_counts=True)
    is_hot = np.isin(ids, hot)[where]
    for kind, some in ((1, (times[where] > 1) & ~is_hot), (2, is_hot)):
        f = first[some]
        out.append((kind, anchor[f].view(np.int64), row[f], at[f], n[f]))
    return pa.table({
        "kind": np.concatenate([np.full(len(o[1]), o[0], np.int32) for o in out]),
        **{k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("anchor", "row", "at", "n"), 1)},
    })


# ---- the suffix array of a group ----------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number in the order of the bytes (0 after the end)."""
    padded = np.concatenate([text, np.zeros(LENGTH + 8, np.uint8)]).astype(np.uint64)
    w = padded
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        w = (w[:-step] << _U(shift)) | w[step:]
    return w


def _sorted_directly(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places in the order of the LENGTH bytes there (and a few more): sorted by the first eight
    bytes, then ties by the next eight, and so on."""
    order = places[np.argsort(words[places], kind="stable")]
    tie = np.zeros(len(order), np.int64)  # number of the group of equals so far
    key = words[order]
    tie[1:] = np.cumsum(key[1:] != key[:-1])
    for depth in range(8, LENGTH, 8):
        times = np.bincount(tie, minlength=1)
        open_ = np.flatnonzero(times[tie] > 1)
        if not len(open_):
            break
        sub, group = order[open_], tie[open_]
        key = words[sub + depth]
        by = np.lexsort((key, group))
        order[open_] = sub[by]
        key, group = key[by], group[by]
        differs = np.ones(len(open_), bool)
        differs[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        step = np.ones(len(order), bool)
        step[1:] = tie[1:] != tie[:-1]
        step[open_] = differs
        tie = np.cumsum(step) - 1
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text (bytes) in the order of their first LENGTH bytes, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = _words(text)
    # Smaller than the successor: the next different byte is larger. The last run is larger than
    # the empty suffix that follows it.
    change = np.flatnonzero(text[1:] != text[:-1])
    run_end = np.append(change, n - 1)
    follows = np.append(text[change + 1] > text[change], False)
    ends = np.searchsorted(run_end, np.arange(n))
    smaller = follows[ends]
    direct = _sorted_directly(np.flatnonzero(smaller), words)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))  # led to by the empty suffix
    whole = []
    for c in range(256):
        front = induced[c]
        part = np.concatenate(front) if front else np.zeros(0, np.int64)
        parts = [part]
        while len(part):  # larger suffixes of the same bucket are led to by those before them
            part = part[part > 0] - 1
            part = part[(text[part] == c) & ~smaller[part]]
            parts.append(part)
        parts.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(parts)
        whole.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            at = np.flatnonzero(np.diff(text[before])) + 1
            for piece in np.split(before, at):
                induced[text[piece[0]]].append(piece)
    return np.concatenate(whole)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix but the first, the bytes that it shares with the one before, LENGTH at most."""
    words = _words(text)
    a, b = order[:-1], order[1:]
    found = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for depth in range(0, LENGTH, 8):
        differ = words[a[open_] + depth] ^ words[b[open_] + depth]
        same = np.zeros(len(open_), np.int64)
        for k in range(8):
            same += differ < _U(1 << (8 * k)) if k else differ == 0
        found[open_] += same
        open_ = open_[same == 8]
        if not len(open_):
            break
    return np.minimum(found, LENGTH)


def _repeats(table: pa.Table) -> pa.Table:
    """Windows of a group's segments that also start earlier: ``row, at, n``."""
    row, at, n = (table.column(c).to_numpy() for c in ("row", "at", "n"))
    parts = table.column("bytes").to_pylist()
    text = np.frombuffer(b"".join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(parts)), size)
    inside = np.arange(len(text)) - begin[owner]
    order = suffix_array(text)
    order = order[inside[order] < n[owner[order]]]  # whole windows only
    same = common_prefixes(text, order) >= LENGTH
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else order
    of_row, of_at = row[owner[order]], (at[owner] + inside)[order]
    by = np.lexsort((of_at, of_row, group))
    g = group[by]
    new = np.ones(len(by), bool)
    new[1:] = g[1:] != g[:-1]
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    later = by[(of_row[by] != of_row[head]) | (of_at[by] != of_at[head])]
    return pa.table(dict(zip(
        ("row", "at", "n"), _runs(of_row[later], of_at[later], np.ones(len(later), np.int64)),
        strict=True)))


def _pieces(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``kind, anchor, row, at, n, bytes``: the segments' bytes, from their texts."""
    by_row = wanted.groupBy("row").agg(
        F.collect_list(F.struct("kind", "anchor", "at", "n")).alias("segments"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts = batch.column(0), as_bytes(batch.column(1))
            ends = batch.column(2).offsets.to_numpy()
            flat = batch.column(2).flatten()
            kind, anchor, at, n = (flat.field(i) for i in range(4))
            begin = ends[0]
            for first in range(0, len(texts), 256):
                stop = min(first + 256, len(texts))
                a, b = ends[first] - begin, ends[stop] - begin
                owner = np.repeat(np.arange(first, stop), np.diff(ends[first : stop + 1]))
                s, m = at.slice(a, b - a).to_numpy(), n.slice(a, b - a).to_numpy()
                cut = [texts[o][x : x + y + LENGTH - 1] for o, x, y in zip(owner, s, m, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [kind.slice(a, b - a), anchor.slice(a, b - a), numbers.take(pa.array(owner)),
                     at.slice(a, b - a), n.slice(a, b - a), pa.array(cut, pa.binary())],
                    names=["kind", "anchor", "row", "at", "n", "bytes"])

    return rows.select("row", "text").join(by_row, "row").mapInArrow(
        per_batch, "kind int, anchor long, row long, at long, n long, bytes binary")


def _hot_repeats(hot: DataFrame) -> DataFrame:
    """Repeats among segments of hot anchors: their windows are compared by all bytes, after a sum
    per task, so that no task gathers an anchor."""
    windows = hot.select("row", "at", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    windows = windows.select(
        "row", (F.col("at") + F.col("k")).alias("at"),
        F.substring("bytes", (F.col("k") + 1).cast("int"), F.lit(LENGTH)).alias("window"))
    first = materialise(
        windows.groupBy(F.col("window").alias("_w")).agg(
            F.min(F.struct("row", "at")).alias("first"), F.count("*").alias("times"))
        .where("times > 1"), "hot_windows")
    return windows.join(first, F.col("window") == F.col("_w")).where(
        F.struct("row", "at") != F.col("first")).select("row", "at", F.lit(1).cast("long").alias("n"))


def _by_size(unsettled: DataFrame) -> tuple[DataFrame, bool]:
    """Segments of anchors that are hot by an exact count made ``kind`` 2, as the sample may have
    missed them; whether there are any."""
    large = materialise(
        unsettled.where("kind = 1").groupBy(F.col("anchor").alias("_large")).count()
        .where(F.col("count") > ANCHORS // 4).select("_large"), "large_anchors")
    many = large.count()
    if not many:
        return unsettled, False
    if many <= BROADCAST_ROWS:
        large = F.broadcast(large)
    kind = F.when(F.col("_large").isNotNull(), 2).otherwise(F.col("kind")).alias("kind")
    return unsettled.join(large, F.col("anchor") == F.col("_large"), "left").select(
        kind, "anchor", "row", "at", "n"), True


def repeats(rows: DataFrame) -> DataFrame:
    """``row, spans`` (array of ``at, n``: so many windows from there also start earlier) from
    ``row, text`` with unique rows; rows without repeats are left out."""
    total, hot = _load(rows)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(partitions, total // ANCHORS)
    settled = materialise(
        _occurrences(rows, groups, hot).groupBy("group").applyInArrow(
            lambda table: _settle(table, hot), "kind int, anchor long, row long, at long, n long"),
        "settled")
    unsettled = settled.where("kind > 0")
    n = unsettled.count()
    runs = settled.where("kind = 0").select("row", "at", "n")
    if n:
        unsettled, more_hot = _by_size(unsettled)
        cut = materialise(_pieces(rows, unsettled), "segments")
        group = F.pmod("anchor", F.lit(max(partitions, n // SEGMENTS))).alias("group")
        more = cut.where("kind = 1").withColumn("group", group).select(
            "group", "row", "at", "n", "bytes").groupBy("group").applyInArrow(
            _repeats, "row long, at long, n long")
        runs = runs.union(more)
        if len(hot) or more_hot:
            runs = runs.union(_hot_repeats(cut.where("kind = 2")))
    return runs.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def _covered(spans: list[dict] | None, size: int) -> np.ndarray:
    """Removed bytes of a text as an array of ranges."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    a = np.array([(s["at"], s["n"]) for s in spans], np.int64)
    a = a[np.argsort(a[:, 0], kind="stable")]
    begin, end = a[:, 0], np.maximum.accumulate(a[:, 0] + a[:, 1] + LENGTH - 1)
    new = np.ones(len(a), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    return np.stack([begin[first], np.minimum(end[last], size)], 1)


def _cut(text: bytes, ranges: np.ndarray) -> bytes:
    at, kept = 0, []
    for a, b in ranges:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def remove(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per row of ``doc_id, text``.

    Texts are bytes in UTF-8, null is empty. Earlier means a smaller doc_id, or an earlier start in
    the same text; rows that repeat a doc_id, or have none, count as later documents. Texts below
    LENGTH bytes lose nothing, and an empty table gives no rows.
    """
    import hashlib

    rows, _ = numbered(docs, "doc_id", "text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                ranges = _covered(spans, len(text))
                kept = _cut(text, ranges)
                out.append((len(text), len(text) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeats(rows)
    return rows.join(found, "row", "left").select("doc_id", "text", "spans").mapInArrow(
        per_batch, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with repeated passages cut out of the texts and ``n_chars``, where there
    is such a column, counted anew. Only whole characters go: one of which a part lies outside a
    removed run stays. Null texts stay null, and texts of which nothing is left stay as empty ones.
    """
    rows = numbered_whole(docs)
    joined = rows.join(repeats(rows), "row", "left").select("text", "spans", "rest")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1).to_pylist()
            out = []
            for text, s in zip(batch.column(0).to_pylist(), spans, strict=True):
                if not s:
                    out.append(text)
                    continue
                data = text.encode()
                ranges = _covered(s, len(data))
                for r in ranges:  # both ends move inward to where a character begins
                    while r[0] < r[1] and data[r[0]] & 0xC0 == 0x80:
                        r[0] += 1
                    while r[0] < r[1] < len(data) and data[r[1]] & 0xC0 == 0x80:
                        r[1] -= 1
                out.append(_cut(data, ranges).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, batch.schema.field(0).type), batch.column(2)], names=["text", "rest"])

    schema = joined.select("text", "rest").schema
    left = restored(joined.mapInArrow(per_batch, schema), docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.length("text").cast(kind))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL for the rows of ``remove`` over ``documents``: every string of LENGTH bytes, in
#: hexadecimal digits, against all others.
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS k
      FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - {LENGTH - 1})) AS i FROM d)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY k) AS first FROM w)
      WHERE (doc_id, i) <> first),
g AS (SELECT doc_id, i, i - {LENGTH} > coalesce(lag(i) OVER o, -{LENGTH} - 1) AS new FROM a
      WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, min(i) AS lo, max(i) + {LENGTH} AS hi FROM r GROUP BY doc_id, run),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after
      FROM s),
c AS (SELECT e.doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last,
             string_agg(substr(x, 2 * after + 1, 2 * (lo - after)), '' ORDER BY lo) AS kept
      FROM e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id"""
