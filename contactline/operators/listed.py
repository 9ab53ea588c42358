"""Which words of a list of any length occur in texts, by an inverted index of grams.

A list that is a table cannot be one pattern. Of each word the gram that fewest texts have stands for
it; texts meet words by their grams, and each meeting is checked. Grams are more than half as long as
their word, up to the last size: a short gram of long words is soon shared by a part of the whole list,
and meetings would grow with texts times words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactline.runtime import materialise

#: Code points of a gram; shorter words than the first size stand for themselves.
SIZES = (4, 8, 16, 32)
#: Grams of words that may be sent to every task.
BROADCAST_GRAMS = 500_000


def _grams(rows: DataFrame, text: str, sizes: Column, key: str) -> DataFrame:
    """``key, gram``: distinct strings of some sizes of each text."""
    last = F.char_length(text) - F.col("_size") + 1
    each = rows.select(key, text, F.explode(sizes).alias("_size")).where(last > 0).select(
        key, text, "_size", F.explode(F.sequence(F.lit(1), last)).alias("_at"))
    grams = each.select(key, text, "_at", F.substr(text, "_at", "_size").alias("gram"))
    return grams.where(F.position("gram", text) == F.col("_at")).select(key, "gram")  # its first place


def _size(word: Column) -> Column:
    """The largest size that the word has."""
    size = F.char_length(word)
    steps = F.when(size < SIZES[0], size)
    for n in reversed(SIZES):
        steps = steps.when(size >= n, n)
    return steps


def listed_words(rows: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """``key, word``: the words (column ``word``) that occur in the text of each row, each once.

    ``key`` tells rows apart. Null texts hold no word; null, empty and repeated words are left out or
    count once.
    """
    words = words.where("word IS NOT NULL AND word <> ''").select("word").distinct().withColumn(
        "size", _size(F.col("word")))
    words = materialise(words, "words")
    of_words = materialise(
        _grams(words.withColumn("_word", F.col("word")), "_word", F.array("size"), "word").join(
            words, "word"), "word_grams")
    many = {r["size"]: r["count"] for r in of_words.groupBy("size").count().collect()}  # seven at most
    if not many:
        return rows.select(key, F.col(text).alias("word")).limit(0)
    texts = materialise(rows.select(key, F.col(text).alias("_text")).where("_text IS NOT NULL"), "texts")
    # Of the sizes that few grams of words have, the texts' other grams are left out at once.
    few = [n for n in many if many[n] <= BROADCAST_GRAMS // len(many)]
    parts = []
    for some in (few, [n for n in many if n not in few]):
        if some:
            grams = _grams(texts, "_text", F.array(*(F.lit(n) for n in some)), key)
            if some is few:
                own = of_words.where(F.col("size").isin(few)).select("gram").distinct()
                grams = grams.join(F.broadcast(own), "gram", "left_semi").select(key, "gram")
            parts.append(grams)
    met = materialise(reduce(DataFrame.unionByName, parts), "grams")
    # Of a word the gram that fewest texts have. A word with a gram that no text has is in none.
    counts = met.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = of_words.join(counts, "gram", "left").groupBy("word").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("_r")).where("_r.n > 0")
    likely = met.join(rarest.select("word", F.col("_r.gram").alias("gram")), "gram").select(key, "word")
    return likely.join(texts, key).where(F.contains("_text", "word")).select(key, "word")
