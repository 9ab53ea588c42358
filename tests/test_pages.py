"""Page parsing: what is visible, what is a link, where addresses are found."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contactline.functions.html import read_page
from contactline.operators import crawl as cr
from contactline.operators import pages as pg
from contactline.rules import ADDRESS_PATTERN, Rules
from contactline.sources.pages import PAGE_FETCH

BASE = "https://oakcare.co.uk/"


def fetches(spark, htmls, base=BASE):
    rows = [(i, "oakcare.co.uk", base, 1, base, 200, h, None) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, PAGE_FETCH)


ADDRESS = "a@x.co.uk"


@pytest.mark.parametrize("markup, by", [
    (f"<p>{ADDRESS}</p>", {"html", "text"}),
    (f"<!-- {ADDRESS} -->", {"html"}),
    (f"<script>'{ADDRESS}'</script>", {"html"}),
    (f"<p hidden>{ADDRESS}</p>", {"html"}),
    (f'<p style="DISPLAY : none">{ADDRESS}</p>', {"html"}),
    (f'<div aria-hidden="true"><p>{ADDRESS}</p></div>', {"html"}),
    (f'<p aria-hidden="TRUE">{ADDRESS}</p>', {"html", "text"}),
    ("<p>a&#64;x.co.uk</p>", {"text"}),
    ("<b>a</b>@x.co.uk", {"text"}),
    ("<p hidden>a [at] x.co.uk</p>", set()),
    ("<footer>a [at] x.co.uk</footer>", {"priority", "text"}),
    ('<div class="big contact"><p>a [at] x.co.uk', {"priority", "text"}),
    ('<div id="contact-us">a [at] x.co.uk</div>', {"priority", "text"}),
    ('<a href=" MAILTO:a%40x.co.uk?subject=1">write</a>', {"mailto"}),
    ('<p hidden><a href="mailto:a%40x.co.uk">write</a></p>', {"mailto"}),
    ("", set()),
])
def test_sources(spark, markup, by):
    rows = pg.page_addresses(pg.parse_pages(fetches(spark, [markup]))).collect()
    assert {r.source for r in rows} == by
    assert all(r.email == ADDRESS and r.is_valid for r in rows)


def test_texts():
    page = read_page("a<main>b<p class=contact>c<i>d</i></main>e<rt>no</rt><br/>f<!-- x -->g</b>h")
    assert page.visible_text == "a b c d e f g h"
    assert page.priority_text == "b c d c d"  # a nested element counts again
    assert read_page("<p hidden>a<b>c</p>d").visible_text == "d"
    assert read_page("x<script>1<2</script>y<br hidden>z").visible_text == "x y z"


def test_links_in_order():
    page = read_page(
        "<p><a href='/x'> A <b>b </b><a href='c'>d</a></p><nav><a>no</a><ul><a href='http://[z'>")
    got = [(k["href"], k["text"], k["in_zone"]) for k in page.links]
    assert got == [("/x", "Ab", False), ("c", "d", False), ("http://[z", "", True)]


def test_other_page_parts(spark):
    html = ("<footer>a@x.uk</footer><nav>b@x.uk</nav><p class=team>c@x.uk</p>"
            "<aside>d@x.uk <a href=/team>t</a></aside><p style='opacity: 0'>e@x.uk</p>")
    rules = Rules(
        hidden_tags=("footer",), hidden_styles=("opacity:0",), priority_tags=("nav",),
        priority_classes=("team",), priority_ids=(), link_zone_tags=("aside",))
    parsed = pg.parse_pages(fetches(spark, [html]), rules)
    rows = pg.page_addresses(parsed).collect()
    assert {r.email for r in rows if r.source == "priority"} == {"b@x.uk", "c@x.uk"}
    assert {r.email for r in rows if r.source == "text"} == {"b@x.uk", "c@x.uk", "d@x.uk"}
    assert [x.stage for x in parsed.first().links] == [pg.STAGE_ZONE]


def plan(spark, html):
    parsed = pg.parse_pages(fetches(spark, [html]))
    homes = parsed.select("site_key", F.col("requested_url").alias("base_url"), "final_url", "links")
    return [r.url for r in cr.candidates(homes).orderBy("rank").collect()]


COMMON = [BASE + p for p in (
    "contact contact-us about about-us careers career jobs vacancies recruitment team").split()]


def test_candidates(spark):
    html = """<a href="/contact/">x</a><a href="/x">Our staff</a><a href="https://jobs.oakcare.co.uk/">Jobs</a>
      <a href="https://other.com/contact">c</a><a href="/news/contact">c</a>
      <a href="/fire-prevention">About</a><a href="/postcode-team">t</a><a href="/x?page=contact">More</a>
      <a href="#contact">c</a><a href="tel:1">contact</a><a href="/">Contact home</a>
      <nav><a href="/contact">c</a><a href="/contact#form">c</a></nav>"""
    assert plan(spark, html) == [
        BASE + "contact", BASE + "contact#form", BASE + "x", "https://jobs.oakcare.co.uk/",
        *COMMON[1:],
    ]


def test_all_candidates_are_kept(spark):
    html = "".join(f'<a href="/team{i}">t</a>' for i in range(40))
    assert plan(spark, html) == [*(f"{BASE}team{i}" for i in range(40)), *COMMON]


def test_a_broken_link_ends_the_search(spark):
    assert plan(spark, '<a href="/contact">c</a><a href="http://[x/">y</a>') == [""]
    assert plan(spark, '<a href="mailto:[x">y</a>') == COMMON


def test_page_report(spark):
    parsed = pg.parse_pages(fetches(spark, ["<p>b@x.org a@x.org noreply@x.org, x@2x.png</p>", ""]))
    row, = pg.page_report(pg.page_addresses(parsed), ["fetch_id"]).collect()
    assert row.found == "a@x.org, b@x.org" and row.n_found == 2 and row.n_ignored == 2
    assert "'noreply@x.org' (Automated no-reply address)" in row.ignored


def test_nested_priority_parts_stay_linear():
    page = read_page("<main>info@x.org ." * 4000)  # 64 KB
    assert len(page.priority_once) < 1_000_000
    rnd = random.Random(2)
    parts = ["<main>", "</main>", "<footer>", "</footer>", "info@", "a [at]", " x.org ", ". b", "(dot) uk", "c"]
    for _ in range(300):
        page = read_page("".join(rnd.choice(parts) for _ in range(12)))
        assert plain_and_spelled(page.priority_text) <= plain_and_spelled(page.priority_once)
        found = set(re.findall(ADDRESS_PATTERN, page.priority_once))
        assert found <= set(re.findall(ADDRESS_PATTERN, page.priority_text))


def plain_and_spelled(text):
    """Addresses of a text by the pattern, as written and after the spellings are resolved."""
    at = re.sub(r"([\w.%+-]+)\s*(?:\[\s*at\s*\]|\(\s*at\s*\))\s*([\w.%+\-\s\[\]()]+)", r"\1@\2", text)
    dots = re.sub(r"\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\))\s*", ".", at)
    spelled = re.sub(r"\s*([@.])\s*", r"\1", dots)
    return set(re.findall(ADDRESS_PATTERN, text)) | set(re.findall(ADDRESS_PATTERN, spelled))


def test_pages_go_to_the_parser_in_bounded_batches(spark):
    """A task's memory does not grow with the pages that it has."""
    import pandas as pd

    from contactline import runtime

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    rows = spark.range(0, 3000, 1, 1).select(
        F.col("id").alias("fetch_id"), F.lit("https://a.org/").alias("requested_url"),
        F.repeat(F.lit("x"), 8000).alias("html"))
    parsed = pg.parse_pages(rows)
    most = F.pandas_udf(lambda s: pd.Series([s.str.len().sum()] * len(s)), "long")
    assert rows.select(most("html").alias("n")).agg(F.max("n")).first()[0] <= 1.1 * runtime.BATCH
    assert parsed.where("has_html").count() == 3000
