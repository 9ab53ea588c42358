"""Words of long lists in texts."""

import random

from contactline.operators import listed
from contactline.operators.listed import listed_words


def test_listed_words_equal_all_pairs(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abé.") for _ in range(n))
    texts = [None, "", "a", "ab", *(word(rnd.randrange(1, 14)) for _ in range(300))]
    words = [None, "", "a", "a", *(word(rnd.randrange(1, 8)) for _ in range(200)), "nowhere at all"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, word string")
    found = listed_words(rows, "id", "word", spark.createDataFrame([(w,) for w in words], "word string"))
    got = [(r.id, r.word) for r in found.collect()]
    want = {(i, w) for i, t in enumerate(texts) for w in words if t and w and w in t}
    assert len(got) == len(set(got)) and set(got) == want
    none = spark.createDataFrame([], "word string")
    assert listed_words(rows, "id", "word", none).count() == 0


def test_a_hundred_thousand_words(spark):
    words = spark.range(100_000).selectExpr("concat('care', id, '.org') AS word")
    rows = spark.range(0, 200_000, 1000).selectExpr("id", "concat('info@care', id, '.org') AS email")
    found = listed_words(rows, "id", "email", words).collect()
    assert sorted(r.id for r in found) == list(range(0, 100_000, 1000))


def test_long_words_meet_no_text_that_lacks_them(spark, monkeypatch):
    """Numbers of a long list share every short run of digits."""
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    numbers = [f"care{rnd.randrange(10_000, 99_999)}." for _ in range(3000)]
    rows = spark.createDataFrame(
        [(i % 1900, f"info@care{rnd.randrange(10_000, 99_999)}.org" if i % 2 else f"a@{numbers[i]}uk")
         for i in range(2000)], "id long, email string")
    words = spark.createDataFrame([(w,) for w in numbers], "word string")
    unique = rows.groupBy("id").agg(F.min("email").alias("email"))
    some = {(r.id, w) for r in unique.collect() for w in set(numbers) if w in r.email}
    assert len(some) > 900
    for most in (500_000, 0):  # grams sent to the tasks, or joined
        monkeypatch.setattr(listed, "BROADCAST_GRAMS", most)
        found = listed.listed_words(unique, "id", "email", words)
        assert sorted(map(tuple, found.collect())) == sorted(some)
        with monkeypatch.context() as m:  # meetings before the check
            m.setattr(F, "contains", lambda text, word: F.lit(True))
            assert listed.listed_words(unique, "id", "email", words).count() == len(some)
