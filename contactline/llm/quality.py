"""Quality classifier: a sparse ensemble of rules.

A small random forest over statistics of whole texts gives paths, each a conjunction of conditions;
a lasso logistic regression weighs these rules and drops most; what is left is one Spark column
expression over the statistics, so scoring needs no model object and no Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactline.llm.common import as_bytes, bounded_batches, packed, pieces, word_hashes
from contactline.runtime import materialise

#: Statistics of a text, in the order in which `statistics` makes them.
STATISTICS = (
    "n_bytes", "n_words", "n_lines", "word_bytes", "upper", "digits", "sentence_marks", "symbols",
    "exclamations", "bars", "blanks", "wide", "distinct_words", "distinct_pairs", "repeated_next",
    "line_bytes",
)


def _class(*codes: int | str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) if isinstance(c, str) else c for c in codes]] = 1
    return table


_CLASSES = {
    "n_lines": _class("\n"),
    "upper": _class(*range(65, 91)),
    "digits": _class(*range(48, 58)),
    "sentence_marks": _class(*".,;:?'\"-()"),
    "symbols": _class(*"#$%&*+/<=>@[\\]^_`{}~"),
    "exclamations": _class("!"),
    "bars": _class("|"),
    "blanks": _class(" ", *range(9, 14)),
    "wide": _class(*range(128, 256)),
}


def _of(texts: list[bytes]) -> dict[str, np.ndarray]:
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = {k: np.add.reduceat(table[data], start) for k, table in _CLASSES.items()}
    count["blanks"] -= 1  # the line feed added to each text
    h, at = word_hashes(texts)
    words = np.diff(at)
    pairs = h[1:] * np.uint64(3) + h[:-1] if len(h) > 1 else h[:0]
    distinct, distinct_pairs, again = (np.zeros(len(texts), np.int64) for _ in range(3))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        distinct[i] = len(np.unique(h[a:b]))
        distinct_pairs[i] = len(np.unique(pairs[a : b - 1])) if b - a > 1 else 0
        again[i] = np.count_nonzero(h[a + 1 : b] == h[a : b - 1]) if b - a > 1 else 0
    n = np.maximum(size - 1, 1)
    out = {"n_bytes": size - 1, "n_words": words, "n_lines": count["n_lines"]}
    out["word_bytes"] = (size - 1 - count["blanks"]) / np.maximum(words, 1)
    for k in ("upper", "digits", "sentence_marks", "symbols", "exclamations", "bars", "blanks", "wide"):
        out[k] = count[k] / n
    out["distinct_words"] = distinct / np.maximum(words, 1)
    out["distinct_pairs"] = distinct_pairs / np.maximum(words - 1, 1)
    out["repeated_next"] = again / np.maximum(words - 1, 1)
    out["line_bytes"] = (size - 1) / count["n_lines"]
    return {k: np.asarray(out[k], float) for k in STATISTICS}


def statistics(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``stats``, an array of STATISTICS of the whole ``text`` (null is empty; an
    empty text has zeros, and one line)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*columns, F.col("text").cast("string").alias("_whole_text"))
    schema = rows.select(
        *columns, F.expr("cast(null as array<double>)").alias("stats")).schema

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.num_columns - 1))
            found = [_of(texts[a:b]) for a, b in pieces(texts)]
            values = np.concatenate(
                [np.stack([f[k] for k in STATISTICS], 1) for f in found]
                or [np.zeros((0, len(STATISTICS)))])
            ends = pa.array(np.arange(len(texts) + 1) * len(STATISTICS), pa.int32())
            stats = pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], stats], names=[*batch.schema.names[:-1], "stats"])

    return rows.mapInArrow(per_batch, schema)


Condition = tuple[int, str, float]
Rule = tuple[Condition, ...]


def paths(forest_text: str) -> list[Rule]:
    """All paths from roots to inner nodes and leaves in the printed form of Spark's tree models."""
    rules: dict[Rule, None] = {}
    held: list[tuple[int, Condition]] = []
    for line in forest_text.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        held = [x for x in held if x[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
        rules[tuple(sorted({c for _, c in held}))] = None
    return list(rules)


def _fits(rule: Rule, stats: Column) -> Column:
    parts = [stats[i] <= v if op == "<=" else stats[i] > v for i, op, v in rule]
    return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        """Chance of label 1 as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_fits(rule, stats), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


#: Labelled documents that a fit takes, about.
FITTED = 40_000


def _share(key: str, wanted: int, n: int) -> Column:
    """About ``wanted`` of ``n`` rows, by a hash of the key."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * min(1.0, wanted / max(n, 1)))


def fit(
    labelled: DataFrame, max_rows: int = FITTED, trees: int = 12, depth: int = 4,
    lasso: float = 5e-4, seed: int = 7,
) -> Ensemble:
    """Rules and weights from ``key, stats, label`` (0 or 1; others are left out).

    Fits on at most about ``max_rows`` rows, chosen by a hash of the key. Without labels the score is
    one half, with labels of one kind their smoothed share.
    """
    labelled = labelled.where(F.col("label").isin(0, 1) & F.col("stats").isNotNull())
    by_label = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(by_label.values())
    if len(by_label) < 2:
        share = (by_label.get(1, 0) + 1) / (n + 2)
        return Ensemble(float(np.log(share / (1 - share))), ())
    sample = materialise(
        labelled.where(_share("key", max_rows, n)).select(
            "key", "stats", F.col("label").cast("double").alias("label")).orderBy("key"),
        "labelled").select(array_to_vector("stats").alias("features"), "label", "stats")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird",
        minInstancesPerNode=10, cacheNodeIds=False).fit(sample)
    rules = paths(forest.toDebugString)
    if not rules:
        share = (by_label[1] + 1) / (n + 2)
        return Ensemble(float(np.log(share / (1 - share))), ())
    marks = F.array(*[_fits(r, F.col("stats")).cast("double") for r in rules])
    model = LogisticRegression(
        featuresCol="marks", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(
        sample.select(array_to_vector(marks).alias("marks"), "label"))
    weights = model.coefficients.toArray()
    kept = tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9)
    return Ensemble(float(model.intercept), kept)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` from ``doc_id, quality``. Labels of held-out documents, null labels and null
    ids are not used; of several labels of a document the largest counts."""
    return labels.where(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("quality").alias("label"))


def learn(stats: DataFrame, labels: DataFrame, **how) -> Ensemble:
    """An ensemble from ``doc_id, stats`` and ``doc_id, quality`` (see ``known_labels``)."""
    return fit(
        stats.join(known_labels(labels), "doc_id").select(
            F.col("doc_id").alias("key"), "stats", "label"), **how)


def _stats(docs: DataFrame) -> DataFrame:
    return packed(statistics(docs, "doc_id"), "statistics")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The score depends on the text alone: repeated rows and rows without id are scored like others,
    null texts like empty ones.
    """
    stats = _stats(docs)
    score = learn(stats, labels, **how).score(F.col("stats"))
    return stats.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")
    ).select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = FITTED, **how
) -> DataFrame:
    """The rows of ``docs``, all columns, whose predicted label is 1.

    About ``max_rows`` labels are chosen first, so that the fit needs the statistics of their
    documents only; all texts are looked at once, when they are scored.
    """
    known = materialise(known_labels(labels), "known_labels")
    chosen = known.where(_share("doc_id", max_rows, known.count()))
    fitted = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = packed(statistics(fitted, "doc_id", "label"), "statistics")
    ensemble = fit(stats.withColumnRenamed("doc_id", "key"), 2 * max_rows, **how)
    score = ensemble.score(F.col("_stats_of_text"))
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    scored = statistics(whole, "_row").withColumnRenamed("stats", "_stats_of_text")
    return scored.where(score >= threshold).select(*[F.col(f"_row.`{c}`") for c in docs.columns])
