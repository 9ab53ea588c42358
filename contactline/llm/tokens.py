"""Token counts of sections: whole documents are encoded once, and the tokens' spans are joined with
the sections' spans.

The vocabulary is byte-level, so tokens are consecutive byte ranges of a text and their lengths give
their spans. Sections are ranges of characters; inside a task both are turned into bytes, and a
binary search in the sorted token starts and ends finds the tokens of each section. Sections may
overlap, be nested, or leave parts of a text out.

A token that crosses a section's boundary is allocated by a rule:
``start`` to sections that hold its first byte, ``end`` to those that hold its last byte, ``share``
to each by the share of its bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactline.llm.common import as_bytes, bounded_batches

#: The pattern that cuts a text before byte pairs are merged (fixed by the public vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("start", "end", "share")
#: Blanks as the pattern counts them, and the length from which a run of them is cut out before the
#: pattern, which would follow it blank by blank, sees it.
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 1000
_encoders: dict[str, tuple] = {}


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file of ranks, through Spark, so that any store will do. Its size is that of a
    vocabulary, about a megabyte."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def _encoder(data: bytes) -> tuple:
    """Encoder, one that takes a text as a single word, and token lengths by id, once per worker."""
    import tiktoken

    key = f"{len(data)} {hash(data)}"
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _encoders.clear()
        made = [tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
                for name, p in (("own", PATTERN), ("whole", r"[\s\S]+"))]
        _encoders[key] = *made, size
    return _encoders[key]


def encoded(encoder, whole, text: str) -> list[int]:
    """Tokens of a text. A long run of blanks is a word of its own but for its last blank, which goes
    to what follows: that is where the pattern cuts it."""
    ids, at = [], 0
    for run in re.finditer(f"[{_BLANKS}]{{{LONG_RUN},}}", text):
        end = run.end() - (run.end() < len(text))
        ids += encoder.encode_ordinary(text[at : run.start()])
        ids += whole.encode_ordinary(text[run.start() : end])
        at = end
    return ids + encoder.encode_ordinary(text[at:])


def _line_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of a text's lines."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    starts = np.concatenate([[0], ends])
    return starts, np.concatenate([ends, [len(text)]])


def attribute(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sections: str | None = None,
    rule: str = "start", vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``key, section, start, end, n_tokens, crossing, doc_tokens``: one row per section.

    ``sections`` names a column of arrays of ``section, start, end`` (code points, end not included);
    without it a text's lines are its sections, each with its line feed. ``n_tokens`` (double) counts
    by the rule, ``crossing`` the tokens of which only a part lies inside. A null text is empty, an
    empty one has one line; null arrays have no sections, sections that reach beyond the text are cut
    to it, null or negative ends count as 0, and an empty table gives no rows. Rows that repeat a
    key are texts of their own. Texts of any length are encoded whole, long runs of blanks included.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    bounded_batches(docs.sparkSession)
    data = read_vocabulary(docs.sparkSession, vocabulary)
    columns = [F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")]
    if sections:
        columns.append(F.col(sections).cast(
            "array<struct<section:int,start:int,end:int>>").alias("sections"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, whole, size = _encoder(data)
        for batch in batches:
            given = batch.column(2).to_pylist() if sections else None
            keys, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            held, out = 0, []
            for i, t in enumerate(texts):
                out.append(_count(
                    encoder, whole, size, keys[i], t, None if given is None else given[i] or [], rule))
                held += len(out[-1][0])
                if held > 50_000:
                    yield _rows(out)
                    held, out = 0, []
            if out:
                yield _rows(out)

    return docs.select(*columns).mapInArrow(
        per_batch,
        "key long, section int, start long, end long, n_tokens double, crossing long, "
        "doc_tokens long",
    ).withColumnRenamed("key", key)


def _count(
    encoder, whole, size: np.ndarray, key, text: bytes, given: list | None, rule: str
) -> tuple:
    data = np.frombuffer(text, np.uint8)
    ids = encoded(encoder, whole, text.decode("utf-8", "replace")) if text else []
    ends = np.cumsum(size[np.asarray(ids, np.int64)]) if ids else np.zeros(0, np.int64)
    starts = ends - size[np.asarray(ids, np.int64)] if ids else ends
    first = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point begins
    if given is None:
        b, e = _line_spans(text)
        numbers = np.arange(len(b))
        cb, ce = np.searchsorted(first, b), np.searchsorted(first, e)
    else:
        numbers = np.array([s["section"] or 0 for s in given], np.int64)
        cb = np.clip([s["start"] or 0 for s in given], 0, len(first)).astype(np.int64)
        ce = np.clip([s["end"] or 0 for s in given], 0, len(first)).astype(np.int64)
        ce = np.maximum(cb, ce)
        at = np.append(first, len(data))
        b, e = at[cb], at[ce]
    after_b, before_e = np.searchsorted(starts, b), np.searchsorted(ends, e, "right")
    begun, ended = np.searchsorted(starts, e), np.searchsorted(ends, b, "right")
    touched = np.where(e > b, begun - ended, 0)
    inside = np.maximum(before_e - after_b, 0)
    crossing = touched - np.where(e > b, inside, 0)
    if rule == "start":
        n = (begun - after_b).astype(float)
    elif rule == "end":
        n = (before_e - ended).astype(float)
    else:
        n = np.where(e > b, inside, 0).astype(float)
        for i in np.flatnonzero(crossing):
            k = np.arange(ended[i], begun[i])
            part = np.minimum(ends[k], e[i]) - np.maximum(starts[k], b[i])
            n[i] = np.sum(part / (ends[k] - starts[k]))
    return [key] * len(b), numbers, cb, ce, n, crossing, np.full(len(b), len(ids))


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    keys = pa.array([k for p in parts for k in p[0]], pa.int64())
    rest = [np.concatenate([p[i] for p in parts]) for i in range(1, 7)]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    arrays = [pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(
        [keys, *arrays],
        names=["key", "section", "start", "end", "n_tokens", "crossing", "doc_tokens"])
