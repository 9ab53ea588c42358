"""Collocations counted in quotient filters.

A word's id is a 64-bit hash of its language and the word; two words of the corpus with one id would
be found out where their counts meet, and the run would start again with other hashes. A phrase is the
packed number of its words' ids. An invertible permutation spreads these numbers evenly; the first bits
of the result (quotient) say where in a filter an entry belongs, the others (remainder) are kept in
full. So the filter is lossless: quotient, remainder and the inverse give back the ids, and the counter
next to a remainder is exact. Each task fills filters of its texts, cut by the first bits of the
quotient; sorted filters of the same range are merged wherever they come from, and what is frequent
leaves them as rows.

A phrase is frequent only if its parts are, so words are counted first, then pairs, then phrases of
three. A bitmap of fixed size tells the tasks which parts cannot be frequent; what it lets through
wrongly is counted and found to be rare.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactline.llm.common import as_bytes, bounded_batches, mix
from contactline.runtime import materialise

#: Occurrences, best phrases of a language, and per cent of a phrase's occurrences that lie in a
#: longer one if it is dropped.
RAREST, FIRST, INSIDE = 10, 2000, 50
#: Words of the longest phrase.
LONGEST = 3
#: Bytes of text that a task holds before it hands its filters on (twice that has fewer than 2 ** 21
#: distinct words, so three of their numbers fit in one), and whose phrases make a range.
HELD, RANGE = 4_000_000, 8 << 20
#: Bits of the bitmap of frequent parts (4 MB), and of a piece of it that one group sets.
MARKS, PIECE = 25, 19
#: Parts in which a language's phrases are ranked before the best of each part meet.
PARTS = 64

_U = np.uint64
#: Between pieces of a text, and between words (fixed values of the contract).
_APART, _BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
_FOLD = bytes(
    10 if b in _APART else 32 if b in _BLANK else b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN, _CUT = re.compile(rb"[^ \n]+|\n"), re.compile(rb"[ \n]")


# ---- the filter --------------------------------------------------------------------------------


def _turned(others: list[np.ndarray]) -> np.ndarray:
    """What the permutation adds to a number, from the others."""
    h = np.zeros(1, np.uint64)
    for i, x in enumerate(others):
        h = mix(h + x + _U(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64)))
    return h


def permuted(ids: list[np.ndarray]) -> list[np.ndarray]:
    """Packed ids (numbers of 64 bits) as numbers that are evenly spread, one to one: each step adds to
    one of them what the others make."""
    numbers = list(ids)
    for i in (*range(len(ids)), 0):
        numbers[i] = numbers[i] + _turned(numbers[:i] + numbers[i + 1 :])
    return numbers


def restored(numbers: list[np.ndarray]) -> list[np.ndarray]:
    """Inverse of ``permuted``."""
    ids = list(numbers)
    for i in (0, *reversed(range(len(ids)))):
        ids[i] = ids[i] - _turned(ids[:i] + ids[i + 1 :])
    return ids


def _order(numbers: list[np.ndarray]) -> np.ndarray:
    """Sorted order of numbers of several words. The first word nearly always decides (sorted stretches
    are merged); where it does not, all do."""
    a, *more = numbers
    order = np.argsort(a, kind="stable")
    s = a[order]
    tie = np.flatnonzero(s[1:] == s[:-1])
    if len(tie) and any((m[order[tie]] != m[order[tie + 1]]).any() for m in more):
        return np.lexsort([*reversed(more), a])
    return order


def summed(numbers: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries in the order of their numbers, equal ones with their counts added."""
    order = _order(numbers)
    numbers = [x[order] for x in numbers]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for x in numbers:
            new[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(new)
    added = np.add.reduceat(counts[order], start) if len(start) else counts[:0]
    return [x[new] for x in numbers], added


def encoded(numbers: list[np.ndarray], counts: np.ndarray, lead: int) -> bytes:
    """A filter of sorted, distinct entries whose first ``lead`` bits are equal.

    After these come as many bits of quotient as make about one slot an entry. Two bit vectors stand
    for the quotients: which slots are taken, and which entries are the last of their slot. Then come
    the remainders, whole bytes of them, and the counters, a byte each; a counter that needs more has
    255 there and follows at the end.
    """
    n = len(counts)
    bits = min(max(n - 1, 0).bit_length(), 32)
    first = numbers[0] << _U(lead) if lead else numbers[0]
    quotient = (first >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
    taken = np.zeros(1 << bits, bool)
    taken[quotient] = True
    ends = np.ones(n, bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    kept = -(-(64 - lead - bits) // 8)  # bytes of the first number that are not in the quotient
    remainder = numbers[0].astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - kept :]
    large = counts >= 255
    return b"".join([
        np.array([n, bits], "<u4").tobytes(), np.packbits(taken).tobytes(), np.packbits(ends).tobytes(),
        np.ascontiguousarray(remainder).tobytes(), *(x.astype("<u8").tobytes() for x in numbers[1:]),
        np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()])


def decoded(data: bytes, lead: int, head: int, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries of a filter; ``head`` is the number that its first ``lead`` bits make."""
    n, bits = (int(x) for x in np.frombuffer(data, "<u4", 2))
    at = 8

    def read(kind, many):
        nonlocal at
        out = np.frombuffer(data, kind, many, at) if many else np.zeros(0, kind)
        at += out.nbytes
        return out

    slots = 1 << bits
    taken = np.unpackbits(read(np.uint8, -(-slots // 8)), count=slots)
    ends = np.unpackbits(read(np.uint8, -(-n // 8)), count=n)
    slot_of = np.zeros(n, np.int64)
    slot_of[1:] = np.cumsum(ends)[:-1]
    quotient = np.flatnonzero(taken)[slot_of].astype(np.uint64)
    kept = -(-(64 - lead - bits) // 8)
    low = np.zeros((n, 8), np.uint8)
    low[:, 8 - kept :] = read(np.uint8, n * kept).reshape(n, kept)
    first = low.view(">u8").reshape(n).astype(np.uint64)
    rest = 64 - lead - bits
    if bits:
        high = (quotient << _U(rest)) if rest < 64 else quotient
        first = (first & _U((1 << rest) - 1)) | high
    if lead:
        first = (first & _U((1 << (64 - lead)) - 1)) | _U(head << (64 - lead))
    more = [read("<u8", n).astype(np.uint64) for _ in range(words - 1)]
    counts = read(np.uint8, n).astype(np.int64)
    large = counts == 255
    counts[large] = read("<i8", int(large.sum()))
    return [first, *more], counts


# ---- the bitmap of frequent parts ----------------------------------------------------------------


def _marks(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that stand for a word or phrase."""
    h = mix(ids[0])
    for x in ids[1:]:
        h = mix(h + x)
    last = _U((1 << MARKS) - 1)
    return (h & last).astype(np.int64), (h >> _U(32) & last).astype(np.int64)


def _marked(bitmap: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    one, two = _marks(ids)
    return (bitmap[one >> 3] >> (one & 7) & bitmap[two >> 3] >> (two & 7) & 1).astype(bool)


def bitmap_of(counts: DataFrame, size: int) -> np.ndarray:
    """Marks of the frequent phrases of a size. Tasks send places, which are made distinct, and each
    piece of the bitmap is set by one group; its bytes are all that comes to the driver."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.unique(np.concatenate(_marks(ids))), pa.int64())], names=["place"])

    def piece(table: pa.Table) -> pa.Table:
        at = np.sort(table.column("place").to_numpy())
        bits = np.zeros(1 << PIECE, np.uint8)
        bits[at & ((1 << PIECE) - 1)] = 1
        data = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"piece": pa.array([int(at[0]) >> PIECE], pa.int64()),
                         "data": pa.array([data], pa.binary())})

    found = counts.where(F.col("size") == size).select(*(f"i{i}" for i in range(size)))
    pieces = found.mapInArrow(places, "place long").distinct().withColumn(
        "piece", F.shiftright("place", PIECE)).groupBy("piece").applyInArrow(
        piece, "piece long, data binary")
    bitmap = np.zeros(1 << (MARKS - 3), np.uint8)
    for row in pieces.collect():
        begin = row["piece"] << (PIECE - 3)
        bitmap[begin : begin + (1 << (PIECE - 3))] = np.frombuffer(row["data"], np.uint8)
    return bitmap


# ---- what a task fills ---------------------------------------------------------------------------


@lru_cache
def _of_lang(lang: bytes, seed: int):
    head = hashlib.blake2b(lang, digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return hashlib.blake2b(head, digest_size=8)


def word_id(lang: bytes, word: bytes, seed: int) -> int:
    """Never 0: that stands for no word."""
    h = _of_lang(lang, seed).copy()
    h.update(word)
    return int.from_bytes(h.digest(), "little") | 1


class _Ids(dict):
    """Numbers of words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self) - 1
        return n


class Pass(NamedTuple):
    """What the tasks of one pass over the texts count: phrases of a size, in ranges of ``lead`` bits."""

    size: int
    seed: int
    lead: int
    bitmap: np.ndarray | None


_FILTERS = "range long, lang string, filter binary, words array<binary>, counts array<long>"


def _filters(
    lang: bytes, texts: list[bytes], how: Pass, tail: int = 0
) -> Iterator[dict]:
    """Filters of some texts of a language. Words are spelled out, phrases packed. The last ``tail``
    words count only as what phrases before them go on with."""
    ids = _Ids({b"": -1, b"\n": 0})
    folded = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ")
    text = np.fromiter(map(ids.__getitem__, folded.split(b" ")), np.int64)
    text = text[text >= 0]
    spelled = list(ids)[2:]
    if not spelled:
        return
    known = np.zeros(len(spelled) + 1, np.uint64)
    known[1:] = np.fromiter((word_id(lang, w, how.seed) for w in spelled), np.uint64, len(spelled))

    def cut(first: np.ndarray):
        """Stretches of sorted entries that belong to one range."""
        if not len(first):
            return []
        head = (first >> _U(64 - how.lead)).astype(np.int64) if how.lead else np.zeros(len(first), np.int64)
        ranges, begin = np.unique(head, return_index=True)
        return zip(ranges.tolist(), begin.tolist(), [*begin[1:].tolist(), len(first)], strict=True)

    row = {"lang": lang, "filter": None, "words": None, "counts": None}
    if how.size == 1:
        times = np.bincount(text[: len(text) - tail], minlength=len(known))
        own = np.flatnonzero(times[1:]) + 1
        own = own[np.argsort(mix(known[own]))]
        for at, a, b in cut(mix(known[own])):
            yield row | {"range": at, "words": [spelled[i - 1] for i in own[a:b]],
                         "counts": times[own[a:b]]}
        return
    size, n = how.size, min(len(text) - how.size + 1, len(text) - tail)
    if n <= 0:
        return
    columns = [text[i : i + n] for i in range(size)]
    # Whole phrases all of whose parts may be frequent.
    if size == 2:
        likely = _marked(how.bitmap, [known])
        likely[0] = False
        open_ = likely[columns[0]] & likely[columns[1]]
    else:
        pair = _marked(how.bitmap, [known[text[:-1]], known[text[1:]]])
        pair &= (text[:-1] > 0) & (text[1:] > 0)
        open_ = pair[:n] & pair[1 : n + 1]
    # Numbers in the task are small, so that a phrase is one number while it is counted.
    bits = len(known).bit_length()
    key = columns[0][open_]
    for c in columns[1:]:
        key = (key << bits) | c[open_]
    key, times = np.unique(key, return_counts=True)
    found = [known[(key >> (bits * (size - 1 - i))) & ((1 << bits) - 1)] for i in range(size)]
    numbers, times = summed(permuted(found), times)
    for at, a, b in cut(numbers[0]):
        yield row | {"range": at, "filter": encoded([x[a:b] for x in numbers], times[a:b], how.lead)}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    get = lambda c, kind: pa.array([r[c] for r in rows], kind)
    return pa.RecordBatch.from_arrays(
        [get("range", pa.int64()), pa.array([r["lang"].decode() for r in rows], pa.string()),
         get("filter", pa.binary()), get("words", pa.list_(pa.binary())),
         get("counts", pa.list_(pa.int64()))],
        names=["range", "lang", "filter", "words", "counts"])


def _stretches(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A very long text cut between words, each stretch followed by the words (and their number) that
    phrases over the cut go on with."""
    text = text.translate(_FOLD)
    end = 0
    while end < len(text):
        begin = end
        cut = _CUT.search(text, begin + HELD)
        end = cut.start() if cut else len(text)
        tail = []
        for token in _TOKEN.finditer(text, end):
            if token[0] == b"\n" or len(tail) == LONGEST - 1:
                break
            tail.append(token[0])
        yield b" ".join([text[begin:end], *tail]), len(tail)


def _fill(how: Pass):
    def batches_of(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for row in rows:
            some.append(row)
            size += len(row["filter"] or b"") or 32 * len(row["words"])
            if size > 1 << 22:
                yield _batch(some)
                some, size = [], 0
        if some:
            yield _batch(some)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[bytes]] = {}
        size: Counter = Counter()
        for batch in batches:
            for lang, text in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1)), strict=True):
                if len(text) > HELD:
                    for stretch, tail in _stretches(text):
                        yield from batches_of(_filters(lang, [stretch], how, tail))
                    continue
                held.setdefault(lang, []).append(text)
                size[lang] += len(text) + 1
                if size.total() > HELD:
                    most = size.most_common(1)[0][0]
                    del size[most]
                    yield from batches_of(_filters(most, held.pop(most), how))
        for lang, texts in held.items():
            yield from batches_of(_filters(lang, texts, how))

    return per_task


_COUNTS = "lang string, size int, i0 long, i1 long, i2 long, word string, f long, clash boolean"


def _merge(how: Pass):
    """Filters of one range merged: frequent phrases, or words and (as size 0) how many words there are."""

    def per_range(table: pa.Table) -> pa.Table:
        head = table.column("range")[0].as_py()
        rows: dict[str, list[int]] = {}
        for i, lang in enumerate(table.column("lang").to_pylist()):
            rows.setdefault(lang, []).append(i)
        parts = []
        for lang, some in rows.items():
            counted = _words(table, some, lang, how) if how.size == 1 else _phrases(table, some, how, head)
            n = len(counted["f"])
            parts.append(pa.table({
                "lang": pa.array([lang] * n, pa.string()),
                "size": pa.array(counted.get("size", [how.size] * n), pa.int32()),
                **{f"i{i}": pa.array(ids.view(np.int64)) for i, ids in enumerate(counted["ids"])},
                **{f"i{i}": pa.nulls(n, pa.int64()) for i in range(len(counted["ids"]), LONGEST)},
                "word": pa.array(counted.get("word", [None] * n), pa.string()),
                "f": pa.array(counted["f"], pa.int64()),
                "clash": pa.array([counted.get("clash", False)] * n, pa.bool_())}))
        return pa.concat_tables(parts)

    return per_range


def _phrases(table: pa.Table, some: list[int], how: Pass, head: int) -> dict:
    parts = [decoded(table.column("filter")[i].as_py(), how.lead, head, how.size) for i in some]
    numbers = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
    numbers, counts = summed(numbers, np.concatenate([p[1] for p in parts]))
    often = counts >= RAREST
    return {"ids": restored([x[often] for x in numbers]), "f": counts[often]}


def _words(table: pa.Table, some: list[int], lang: str, how: Pass) -> dict:
    """Counts of words, whether two of them have one id, and the sum of all counts."""
    times: dict[bytes, int] = {}
    for i in some:
        words, counts = table.column("words")[i].as_py(), table.column("counts")[i].as_py()
        for w, n in zip(words, counts, strict=True):
            times[w] = times.get(w, 0) + n
    key = lang.encode()
    ids = {word_id(key, w, how.seed) for w in times}
    often = [(w, n) for w, n in times.items() if n >= RAREST]
    first = [0, *(word_id(key, w, how.seed) for w, _ in often)]
    return {
        "size": [0] + [1] * len(often), "word": [None, *(w.decode() for w, _ in often)],
        "f": np.array([sum(times.values()), *(n for _, n in often)], np.int64),
        "ids": [np.array(first, np.uint64)], "clash": len(ids) < len(times)}


# ---- phrases -------------------------------------------------------------------------------------


def frequent(docs: DataFrame, seeds: int = 4) -> DataFrame:
    """``lang, size, i0, i1, i2, word, f``: phrases of up to LONGEST words with RAREST occurrences (of
    size 1 with the word itself), and per range the number of all words of a language (size 0)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    lead = min(max(0, (total // RANGE).bit_length()), 30)

    def counted(how: Pass) -> DataFrame:
        return materialise(
            docs.mapInArrow(_fill(how), _FILTERS).groupBy("range").applyInArrow(_merge(how), _COUNTS),
            f"phrases_{how.size}")

    for seed in range(seeds):
        found = counted(Pass(1, seed, lead, None))
        if found.where("clash").isEmpty():
            break
    else:
        raise RuntimeError("words of this corpus share ids under every seed")
    last = found
    for size in range(2, LONGEST + 1):
        last = counted(Pass(size, seed, lead, bitmap_of(last, size - 1)))
        found = found.unionByName(last)
    return found.drop("clash")


def _score(a: Column, first: Column, rest: Column) -> Column:
    """floor(1000000 a a / (l r)) in exact decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(first) * wide(rest)).cast("decimal(38,0)"))


def scored(counts: DataFrame) -> DataFrame:
    """``lang, size, i0, i1, i2, a, l, r, score`` of phrases of two words and more, each by the cut with
    the lowest score, without those that mostly lie in a longer one."""
    def of(size: int, names: list[str], f: str) -> DataFrame:
        keys = [F.col(f"i{i}").alias(n) for i, n in enumerate(names)]
        return counts.where(F.col("size") == size).select("lang", *keys, F.col("f").alias(f))

    two = (
        of(2, ["i0", "i1"], "a").join(of(1, ["i0"], "l"), ["lang", "i0"])
        .join(of(1, ["i1"], "r"), ["lang", "i1"])
        .withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))).withColumn("i2", F.lit(None).cast("long")))
    three = (
        of(3, ["i0", "i1", "i2"], "a")
        .join(of(1, ["i0"], "l1"), ["lang", "i0"]).join(of(2, ["i1", "i2"], "r1"), ["lang", "i1", "i2"])
        .join(of(2, ["i0", "i1"], "l2"), ["lang", "i0", "i1"]).join(of(1, ["i2"], "r2"), ["lang", "i2"]))
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                     F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    three = three.withColumn("_cut", F.least(*cuts)).select(
        "lang", "i0", "i1", "i2", "a", "_cut.l", "_cut.r", "_cut.score")
    longer = of(3, ["i0", "i1", "i2"], "f")
    inside = F.explode(F.array(
        F.struct(F.col("i0"), F.col("i1")), F.struct(F.col("i1").alias("i0"), F.col("i2").alias("i1"))))
    most = longer.select("lang", "f", inside.alias("_in")).groupBy(
        "lang", F.col("_in.i0").alias("i0"), F.col("_in.i1").alias("i1")).agg(F.max("f").alias("_f"))
    two = two.join(most, ["lang", "i0", "i1"], "left").where(
        F.col("_f").isNull() | (100 * F.col("_f") < INSIDE * F.col("a")))
    columns = ["lang", "i0", "i1", "i2", "a", "l", "r", "score"]
    return two.select(*columns).unionByName(three.select(*columns))


def collocations(docs: DataFrame) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the FIRST best phrases of each language of ``docs``
    (text, lang).

    A null language is ``und``, null and empty texts have no words, equal rows count each, and texts of
    any length are counted whole. Phrases of equal score and count stand in the order of their bytes. A
    language without a frequent phrase gives no row; other columns are not read.
    """
    counts = frequent(docs)
    best = [F.col("score").desc(), F.col("a").desc()]
    part = F.pmod(F.xxhash64("i0", "i1", "i2"), F.lit(PARTS))
    # No window holds all phrases of a language: the best of each part meet, ties spelled out first.
    likely = scored(counts).withColumn("_part", part).withColumn(
        "_rank", F.rank().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(
        F.col("_rank") <= FIRST).drop("_rank")
    likely = materialise(likely, "phrases")
    words = counts.where("size = 1")
    for i in range(LONGEST):
        likely = likely.join(
            words.select("lang", F.col("i0").alias(f"i{i}"), F.col("word").alias(f"w{i}")),
            ["lang", f"i{i}"], "left")
    phrase = F.concat_ws(" ", *(f"w{i}" for i in range(LONGEST)))
    likely = likely.withColumn("phrase", phrase)
    order = [*best, F.col("phrase")]
    for keys in (["lang", "_part"], ["lang"]):
        likely = likely.withColumn(
            "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
            F.col("rank") <= FIRST)
    total = counts.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return likely.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for ``collocations`` over ``documents``.
SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents),
spots AS (
  SELECT lang, words[i] AS w1, words[i + 1] AS w2, words[i + 2] AS w3
  FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces)),
total AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
one AS (SELECT lang, w1, count(*) AS f FROM spots GROUP BY ALL HAVING count(*) >= {RAREST}),
two AS (
  SELECT lang, w1, w2, count(*) AS f FROM spots WHERE w2 IS NOT NULL GROUP BY ALL
  HAVING count(*) >= {RAREST}),
three AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM spots WHERE w3 IS NOT NULL GROUP BY ALL
  HAVING count(*) >= {RAREST}),
longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (
    SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM two c JOIN one x ON x.lang = c.lang AND x.w1 = c.w1 JOIN one y ON y.lang = c.lang AND y.w1 = c.w2
  LEFT JOIN longer ON longer.lang = c.lang AND longer.w1 = c.w1 AND longer.w2 = c.w2
  WHERE longer.f IS NULL OR 100 * longer.f < {INSIDE} * c.f
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, x.f, y.f, 1
  FROM three c JOIN one x ON x.lang = c.lang AND x.w1 = c.w1
  JOIN two y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, x.f, y.f, 2
  FROM three c JOIN two x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2
  JOIN one y ON y.lang = c.lang AND y.w1 = c.w3),
scores AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (
  SELECT lang, phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score
  FROM scores GROUP BY lang, phrase, a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest)
JOIN total USING (lang) WHERE rank <= {FIRST}
"""
