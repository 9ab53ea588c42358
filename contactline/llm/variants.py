"""Spelling variants by composing finite-state machines.

The vocabulary is accepted by a minimal acyclic automaton. A second machine with two states rewrites
one code point: before the edit it copies, or replaces, inserts or deletes once, and after the edit it
copies. Automaton, edit and automaton again, composed, accept exactly the pairs of words one edit
apart; the pairs are read off its paths.

The composition is cut by its initial states. Two words that differ by one edit share either the
first half of the shorter one (its length is ``m``) or the last half, so each partition holds the words
of ``m`` and ``m + 1`` code points that begin (or, spelled backwards, end) alike, and composes the
automaton of what is left of them. An inserted code point counts as the last of a row of equal ones, so
that every pair is accepted on one path, in one partition. A partition that is too large is cut at its
initial state: words that go on alike move one state on, and an edit at the state itself leaves words
that must be equal after it, at most one for each code point.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactline.llm.common import as_bytes, bounded_batches
from contactline.llm.graph import _roots
from contactline.runtime import materialise

#: Code points and occurrences that a word needs.
SHORTEST, RAREST = 5, 3
#: A run of letters loses a code point if this divides its hash.
TYPO = 97
#: Words of a partition at most (more than there are letters, as that many can differ in one place and
#: agree in all others), and of the partitions that a group of Python holds, about.
PARTITION, GROUP = 20_000, 40_000
#: Distinct words that a task counts before it hands them on.
HELD = 400_000

_RUN = re.compile("[a-z\u00C0-\u00FF]+")


# ---- words -------------------------------------------------------------------------------------


def mistyped(doc_id: bytes, words: Counter) -> Iterator[tuple[str, int]]:
    """Words of a document and their counts, some without one code point."""
    begin = zlib.crc32(doc_id + b":")
    for word, n in words.items():
        h = zlib.crc32(word.encode(), begin)
        if h % TYPO == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= SHORTEST:
            yield word, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words that are long and frequent enough. Null texts have no words."""
    bounded_batches(docs.sparkSession)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1)), strict=True):
                found = Counter(_RUN.findall(text.lower().decode()))
                for word, n in mistyped(doc_id, found):
                    counts[word] += n
                if len(counts) >= HELD:
                    yield handed_on()
        if counts:
            yield handed_on()

    words = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(
        per_task, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


# ---- machines ----------------------------------------------------------------------------------


class Acceptor:
    """A minimal acyclic automaton: states with the same arcs and finality are one, those of several
    sets of words too. ``add`` gives the initial state of a set."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]  # the first state leads nowhere
        self.final: list[bool] = [False]
        self._known: dict[tuple, int] = {(False,): 0}

    def add(self, words: list[str]) -> int:
        words = sorted(words)
        # Calls go as deep as words are long.
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * max(map(len, words), default=0) + 2000))
        return self._state(words, 0, len(words), 0)

    def _state(self, words: list[str], lo: int, hi: int, depth: int) -> int:
        """State after ``depth`` code points, which ``words[lo:hi]`` share."""
        final = False
        while lo < hi and len(words[lo]) == depth:
            final, lo = True, lo + 1
        arcs = {}
        while lo < hi:
            c, end = words[lo][depth], hi
            if words[hi - 1][depth] != c:
                end, top = lo + 1, hi
                while end < top:  # the first word that goes on otherwise
                    mid = (end + top) // 2
                    if words[mid][depth] == c:
                        end = mid + 1
                    else:
                        top = mid
            arcs[c] = self._state(words, lo, end, depth + 1)
            lo = end
        key = (final, *arcs.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return state


class Composition:
    """Acceptor, one edit, acceptor. Pairs of words of ``short``, one code point replaced, and pairs of
    a word of ``short`` and one of ``long``, one code point inserted; each pair once.

    Before the edit both sides have read the same, so the states are those that one word leads to.
    After it both go on alike, and a pair of states is dead if no word is accepted from both.
    """

    def __init__(self, short: list[str], long: list[str]):
        self.a = Acceptor()
        self.start = self.a.add(short), self.a.add(long)
        self._alive: dict[tuple[int, int], bool] = {}

    def _meet(self, p: int, q: int) -> bool:
        if p == q:
            return p != 0
        key = (p, q) if p < q else (q, p)
        known = self._alive.get(key)
        if known is None:
            known = self.a.final[p] and self.a.final[q]
            if not known:
                b = self.a.arcs[q]
                for c, to in self.a.arcs[p].items():
                    if c in b and self._meet(to, b[c]):
                        known = True
                        break
            self._alive[key] = known
        return known

    def _rest(self, p: int, q: int, without: str = "") -> Iterator[str]:
        """Words accepted from both states, but for those that begin with ``without``."""
        path: list[str] = []
        stack = [(p, q, 0, "")]
        while stack:
            p, q, depth, c = stack.pop()
            if depth:
                del path[depth - 1 :]
                path.append(c)
            if self.a.final[p] and self.a.final[q]:
                yield "".join(path)
            b = self.a.arcs[q]
            for c, to in self.a.arcs[p].items():
                if c in b and (depth or c != without) and self._meet(to, b[c]):
                    stack.append((to, b[c], depth + 1, c))

    def pairs(self) -> Iterator[tuple[str, str]]:
        path: list[str] = []
        stack = [(*self.start, 0, "")]
        while stack:
            p, q, depth, c = stack.pop()
            if depth:
                del path[depth - 1 :]
                path.append(c)
            short, long = self.a.arcs[p], self.a.arcs[q]
            arcs = list(short.items())
            for i, (c, one) in enumerate(arcs):
                for d, other in arcs[i + 1 :]:
                    if self._meet(one, other):
                        read = "".join(path)
                        for rest in self._rest(one, other):
                            yield read + c + rest, read + d + rest
                stack.append((one, long.get(c, 0), depth + 1, c))
            for c, to in long.items():
                if self._meet(p, to):
                    for rest in self._rest(p, to, c):
                        read = "".join(path)
                        yield read + rest, read + c + rest


# ---- partitions --------------------------------------------------------------------------------


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``part``, a hash of the state. Two states with one hash are told apart by ``state``."""
    return rows.withColumn("part", F.xxhash64("state"))


def _partitions(words: DataFrame) -> DataFrame:
    """``state, rest, word, n, m, backward, part``: words by initial state, each up to four times (as
    the shorter and as the longer word of a pair, spelled forward and backward)."""
    size, m = F.char_length("word"), F.col("m")
    words = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(m >= SHORTEST)
    words = words.select(
        "*", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"),
        F.floor(m / 2).cast("int").alias("_half"))
    read = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    shared = F.when(F.col("backward"), m - F.col("_half")).otherwise(F.col("_half"))
    state = F.concat_ws(
        " ", m, F.when(F.col("backward"), "b").otherwise("f"), F.substring(read, F.lit(1), shared))
    return _keyed(words.select(
        state.alias("state"), F.substring(read, shared + 1, size).alias("rest"), "word", "n", "m",
        "backward"))


def _cut(rows: DataFrame) -> DataFrame:
    """Rows of too large partitions by the states that follow: the next code point read, or the edit
    made at the state itself. After that, what follows is part of the state."""
    rest, state = F.col("rest"), F.col("state")
    first, tail = F.substring("rest", 1, 1), F.substring("rest", F.lit(2), F.char_length("rest"))
    longer = F.char_length("word") > F.col("m")
    go = lambda state, rest, keep: F.when(
        keep, F.struct(state.alias("state"), rest.alias("rest")))
    ways = F.array(
        go(F.concat(state, first), tail, rest != ""),
        go(F.concat(state, F.lit(" replaced "), tail), first, ~longer & (rest != "")),
        # Of equal code points the last one is the inserted one.
        go(F.concat(state, F.lit(" inserted "), F.when(longer, tail).otherwise(rest)),
           F.when(longer, first).otherwise(""), ~longer | (first != F.substring("rest", 2, 1))))
    return _keyed(rows.select("word", "n", "m", "backward", F.explode(ways).alias("_go"))
                  .where("_go IS NOT NULL").select("_go.*", "word", "n", "m", "backward"))


def _near(table: pa.Table) -> pa.Table:
    """For the words of some partitions: how many near words they have there, and the best of these."""
    best: dict[str, list] = {}

    def met(word: str, other: str, n: int) -> None:
        known = best.get(word)
        if known is None:
            best[word] = [1, n, other]
            return
        known[0] += 1
        if (-n, other) < (-known[1], known[2]):
            known[1:] = n, other

    def partition(rows: list[tuple]) -> None:
        m, backward = rows[0][4], rows[0][5]
        short = {rest: (word, n) for _, rest, word, n, _, _ in rows if len(word) == m}
        long = {rest: (word, n) for _, rest, word, n, _, _ in rows if len(word) > m}
        if not short or len(rows) < 2:
            return
        for x, y in Composition(list(short), list(long)).pairs():
            word, n = short[x]
            # A pair of words of one length has both in ``short``; ``rest`` tells them apart.
            other, other_n = short[y] if len(y) == len(x) else long[y]
            if backward and len(other) > m and other[: m // 2] == word[: m // 2]:
                continue  # met in the forward partitions
            met(word, other, other_n)
            met(other, word, n)

    rows: list[tuple] = []
    columns = ["state", "rest", "word", "n", "m", "backward"]
    table = table.select(columns).sort_by("state")
    for row in zip(*(table.column(c).to_pylist() for c in columns), strict=True):
        if rows and row[0] != rows[0][0]:
            partition(rows)
            rows = []
        rows.append(row)
    if rows:
        partition(rows)
    return pa.table({
        "word": pa.array(best.keys(), pa.string()),
        "n_near": pa.array([b[0] for b in best.values()], pa.int64()),
        "best_n": pa.array([b[1] for b in best.values()], pa.int64()),
        "best": pa.array([b[2] for b in best.values()], pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` for words (``word, n``, distinct, written) with a near word."""
    rows, done = materialise(_partitions(words), "partitions"), []
    many = rows.count()
    while True:
        large = materialise(
            rows.groupBy("part").count().where(F.col("count") > PARTITION).select("part"), "large")
        if large.isEmpty():
            break
        done.append(rows.join(large, "part", "left_anti"))
        rows = materialise(_cut(rows.join(large, "part", "left_semi")), "partitions")
    for part in done:
        rows = rows.unionByName(part)
    near = rows.withColumn("_group", F.pmod("part", F.lit(1 + many // GROUP))).groupBy(
        "_group").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", (-F.col("_best.n")).alias("best_n"), F.col("_best.word").alias("best"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of ``docs`` (doc_id, text).

    A word's form is its most frequent near word, if that occurs twice as often at least; its root is
    where forms lead. Null and empty texts have no words, a null doc_id counts as an empty one in the
    hash, rows that repeat a doc_id count as they come, and words of any length are read whole. Ties go
    to the smallest word by code points. No rows give none; other columns are not read.
    """
    words = materialise(vocabulary(docs), "vocabulary")
    near = materialise(near_words(words), "near_words")
    found = words.join(near, "word", "left")
    form = F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best"))
    found = materialise(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    led = found.where("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("parent"))
    top = _roots(led, led.count()).select(F.col("node").alias("word"), F.col("parent").alias("_root"))
    return found.join(top, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root"))


#: DuckDB SQL for ``spelling_variants`` over ``documents``. Words are one edit apart if they are equal
#: without the code point at one place, or if one is the other without a code point.
SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(
      range(length(x) // 2), lambda i: ('0x' || substr(x, 1 + 2 * i::INT, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM hexed, bits),
typed AS (
  SELECT CASE WHEN h % {TYPO} <> 0 THEN run
    ELSE substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) END AS word, n
  FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= {SHORTEST}
  GROUP BY word HAVING sum(n) >= {RAREST}),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (i, rest)
  WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n,
    arg_min(other, (-other_n, other)) AS best FROM near GROUP BY word),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
led AS (
  SELECT word, coalesce(form, word) AS leads_to, 0 AS step FROM forms
  UNION ALL
  SELECT led.word, forms.form, step + 1 FROM led JOIN forms ON led.leads_to = forms.word
  WHERE forms.form IS NOT NULL AND step < 64),
top AS (SELECT word, arg_max(leads_to, step) AS root FROM led GROUP BY word)
SELECT forms.word, n, n_near, form, form_n, root FROM forms JOIN top USING (word)
"""
