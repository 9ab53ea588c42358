"""Addresses of nested priority texts against those of the whole text."""

import random

import pytest
from pyspark.sql import functions as F

from contactline.functions import addresses as ad
from contactline.functions.html import read_page
from contactline.functions.seams import LONGEST_WORD, address_text


def addresses(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", F.array_distinct(ad.find_in_text(F.col("t"))).alias("a")).collect()
    return {r.i: set(r.a) for r in rows}


def whole(nodes, ranges):
    return " ".join(" ".join(nodes[a:b]) for a, b in ranges)


def nested(rnd, n):
    """Ranges of n nodes that lie in each other or apart, in the order in which they begin."""
    out = []

    def inside(a, b, depth):
        while a <= b and depth and rnd.random() < 0.6:
            lo = rnd.randint(a, b)
            hi = rnd.randint(lo, b)
            out.append([lo, hi])
            inside(lo, hi, depth - 1)
            a = hi

    inside(0, n, 4)
    return out


WORDS = ["info", "a.b", "x.org", "jane [at] home", "[at]", "( AT )", "@", " @ ", "b@c.de", "(dot)", " [dot] uk", ".",
         ". ", "co.uk", "é", ",", ", ", "!", "[", ")", "-", "x-", "_", " ", "\n", "ſ", "foo bar", "y", "%", "½", " "]


@pytest.mark.parametrize("seed,long", [(1, 1), (2, 1), (3, 1), (4, 60), (5, 60)])
def test_addresses_equal_those_of_the_whole_text(spark, seed, long):
    rnd = random.Random(seed)
    cases = []
    words = WORDS if long == 1 else WORDS[:14]
    for _ in range(1200 if long == 1 else 600):
        some = rnd.sample(words, rnd.randint(3, len(words)))
        nodes = []
        for _ in range(rnd.randint(1, 7)):
            parts = [rnd.choice(some) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 4))]
            if long > 1 and rnd.random() < 0.5:  # words far from a seam
                parts.insert(rnd.randint(0, len(parts)), "plain words " * rnd.randint(10, long))
            nodes.append("".join(parts))
        ranges = nested(rnd, len(nodes))
        cases.append((nodes, ranges))
    want = addresses(spark, [whole(*c) for c in cases])
    got = addresses(spark, [address_text(*c) for c in cases])
    bad = [(c, want[i], got[i]) for i, c in enumerate(cases) if want[i] != got[i]]
    assert not bad, (len(bad), min(bad, key=lambda x: len(str(x[0]))))
    assert sum(map(bool, want.values())) > 50


def test_a_long_spelled_domain_over_a_seam(spark):
    long = ".".join(f"sub{i}" for i in range(30))
    pages = [
        f"<main><footer>mail jane [at]</footer><header>{long} [dot] example [dot] co [dot] uk</header></main>",
        f"<main><footer>{long} [at] x</footer><header>{long} [dot] example jane [at] y.org</header></main>",
        f"<main>a@<main>{long}<main>{'w ' * 200}</main>.org</main> b [at] c.org</main>",
    ]
    parsed = [read_page(p) for p in pages]
    want = addresses(spark, [p.priority_text for p in parsed])
    assert addresses(spark, [p.priority_once for p in parsed]) == want
    assert any(a.endswith("sub29.example.co.uk") for a in want[0])


@pytest.mark.parametrize("part", ["<main>info@x.org .", "<main>some words and [at] more ", "<main>a, b@c.de "])
def test_deep_nesting_stays_linear(part):
    page = read_page(part * 4000)
    assert len(page.priority_once) < 12 * 4000 * len(part) + 2 * LONGEST_WORD


def test_nothing():
    assert address_text([], []) == "" and address_text(["a"], []) == ""
    assert address_text(["", ""], [[0, 0], [0, 2], [1, 1]]).strip(" |") == ""
