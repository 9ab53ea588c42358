"""Column functions against fixed cases, the standard library and a second engine."""

import random
import re
import time
from urllib.parse import urljoin, urlparse, urlsplit

import duckdb
import pytest
from pyspark.sql import functions as F

from contactline.functions import addresses as ad
from contactline.functions import text, urls
from contactline.operators import pages as pg
from contactline.operators.crawl import navigation_reason
from contactline.plans import oracles
from contactline.rules import ADDRESS_PATTERN, Rules


def test_strip_and_absent(one):
    assert one(text.strip, ["  a b\t\n", "", "x", "\x1c y　"]) == ["a b", "", "x", "y"]
    assert one(text.absent_to_null, [" NaN ", "", None, " x ", "nano"]) == [None, None, None, "x", "nano"]


def test_root_domain(one):
    cases = {
        "www.a.co.uk": "a.co.uk", "a.b.example.com": "example.com", "me.com": "me.com",
        "www.me.com": "www.me.com", "x.y.uk": "y.uk", "192.168.1.10": "1.10", ".a.b.c.": "b.c",
        "u:p@h.co.uk": "u", ":80": "", "": "", "A.Sch.UK:443": "a.sch.uk", "a..b": ".b",
    }
    assert one(urls.root_domain, cases) == list(cases.values())


def test_url_parts_agree_with_the_standard_library(one):
    rng = random.Random(5)
    bits = [".", "a", "co", "com", "uk", "x", ":", "/", "?", "#", "http:", "//", "%", " ", "\t", "@"]
    samples = ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(3000)]
    samples += ["https://www.A.co.uk:80/x;p?y#z", "1http://x.y", "\x01http://q.com", "host:80/x"]
    want = [urlparse(u) for u in samples]
    assert one(urls.scheme, samples) == [w.scheme for w in want]
    assert one(urls.netloc, samples) == [w.netloc for w in want]
    assert one(urls.path, samples) == [w.path for w in want]


def test_links_resolve_as_in_the_standard_library(spark):
    def want(page, link):
        try:
            whole = urljoin(page, link)
            urlsplit(whole)
            return whole
        except ValueError:
            return None

    rng = random.Random(8)
    bits = ["/", "/", "/", "a", "b", ".", "..", "../", "./", ";p", "?q", "#f", "http:", "https:", "//",
            "mailto:", "ftp:", ":", " ", "\t", "[", "]", "[::1]", "é", "\u2100", "\u2028", "@", "%"]
    links = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(6000)]
    pages = ["", "http://h", "http://h/", "https://u@h:1/a/b;p?q#f", "http://h/a//b/", "x/y", "mailto:z",
             "ftp://h/../a/", "http:a/b", "//h/a;p/b"]
    pages += ["".join(rng.choices(bits, k=rng.randint(1, 6))) for _ in range(40)]
    cases = [(pages[i % len(pages)], x) for i, x in enumerate(links)]
    df = spark.createDataFrame([(i, p, x) for i, (p, x) in enumerate(cases)], "i int, page string, link string")
    rows = df.select("i", urls.resolve(F.col("page"), F.col("link")).alias("out")).collect()
    got = {r.i: r.out for r in rows}
    wrong = [(p, x, got[i], want(p, x)) for i, (p, x) in enumerate(cases) if got[i] != want(p, x)]
    assert wrong == []


def test_url_forms(one):
    assert one(urls.with_scheme, [" a.b ", "http://x", "HTTPS://x", "https://y"]) == [
        "https://a.b", "http://x", "https://HTTPS://x", "https://y"]
    assert one(urls.canonical, ["https://A.b/C//", "https://a.b/?q=1/"]) == [
        "https://a.b/c", "https://a.b/?q=1"]
    assert one(urls.homepage, ["https://www.OakCare.co.uk:8443/homes/1?x=2", "a.org/x", ""]) == [
        "https://www.OakCare.co.uk:8443/", "https://a.org/", ""]


def test_blocked(one):
    cases = {
        "https://www.yell.com/biz": True, "yell.com/biz": True, "https://notyell.com": False,
        "https://netflix.com": False, "https://council.gov.uk": True, "https://gov.uk": True,
        "https://a.nhs.wales": True, "https://yell.com:443/": True, "": True, "https://[x": True,
        "https://elm.org": False,
    }
    assert one(urls.is_blocked, cases) == list(cases.values())
    assert one(lambda c: urls.is_blocked(c, Rules(blocked_domains=("elm.org",))),
               ["https://www.elm.org/"]) == [True]


def test_find_addresses_agrees_with_the_pattern(one):
    rng = random.Random(7)
    bits = list("ab.@-_é%+1Z, ") + ["com", ".co", " ", "@x.org"]
    samples = ["".join(rng.choices(bits, k=rng.randint(3, 40))) for _ in range(5000)]
    samples += ["a@b.com-x@y.org", "éin-fo@x.com", "u003einfo@x.com", "éinfo@x.com b@y.org"]
    assert one(ad.find_addresses, samples) == [re.findall(ADDRESS_PATTERN, s) for s in samples]


@pytest.mark.parametrize("given, found", [
    ("manager [at] penns.co.uk", {"manager@penns.co.uk"}),
    ("a (AT) b (dot) com", {"a@b.com"}),
    ("a [at] b.com c [at] d.com", {"a@b.com"}),
    ("Email info@x.com. Call us", {"info@x.com", "info@x.com.call"}),
    ("meet @ noon. today", {"meet@noon.today"}),
    ("info @ x.com", {"info@x.com"}),
    ("no address, at all (at) [at]", set()),
])
def test_find_in_text(one, given, found):
    assert set(one(ad.find_in_text, [given])[0]) == found


def test_spelled_out_addresses_agree_with_sql(one):
    rng = random.Random(11)
    bits = list("ab.@-_%+1Z, \n") + ["[at]", "(at)", "[ dot ]", "(DOT)", " ", "com", ".co", "( AT )"]
    samples = ["".join(rng.choices(bits, k=rng.randint(3, 40))) for _ in range(5000)]
    con = duckdb.connect()
    sql = f"SELECT list_transform({oracles._find(oracles._spell_out('t'))}, lambda x: {oracles._clean('x')})"
    con.execute("CREATE TABLE s (i INT, t VARCHAR)")
    con.executemany("INSERT INTO s VALUES (?, ?)", list(enumerate(samples)))
    want = [r[0] for r in con.execute(f"{sql} FROM s ORDER BY i").fetchall()]
    assert one(ad.find_obfuscated, samples) == want


def test_patterns_stay_linear_on_long_runs(one):
    runs = ["a" + "b-" * 400_000 + "@", " " * 800_000 + "@", "x" + " " * 400_000 + "[at" + " .," * 90_000]
    start = time.time()
    assert one(ad.find_in_text, runs) == [[], [], []]
    assert time.time() - start < 30


def test_mailto(one):
    cases = {
        "mailto:a+b%40x.com?subject=Hi": "a+b@x.com", "mailto:a%zz@x.com": "a%zz@x.com",
        " MAILTO: a%2Bb@x.com ": "a+b@x.com", "mailto:?x": "", "mailto:a%zz%40x.com": "a%zz@x.com",
    }
    assert one(ad.mailto_address, cases) == list(cases.values())


@pytest.mark.parametrize("email, reason", [
    ("", "Invalid email format"), ("plain", "Invalid email format"),
    ("-a@b.com", "Failed standard regex validation"),
    ("a@b@c.com", "Failed standard regex validation"),
    ("a@b.com\n", "Failed standard regex validation"),
    ("test@example.com", "Matched dummy/test email blocklist"),
    ("logo@2x.png", "Static asset extension (.png)"),
    ("noreply@oakcare.co.uk", "Automated no-reply address"),
    ("mediation@oakcare.co.uk", "Username starts with ignored keyword ('media')"),
    ("x@mytwitterfans.co.uk", "Technical / analytics / social domain ('twitter')"),
    ("a@mydomain.com", "Technical / analytics / social domain ('domain.com')"),
    ("a@sentry.wixpress.com", "Technical / analytics / social domain ('sentry.wixpress.com')"),
    ("gp@surgery.nhs.uk", "Regulator / NHS / Gov domain ('nhs.uk')"),
    ("a@b.nhs.scot", "Government or NHS domain suffix"),
    ("sales@oakcare.co.uk", None), ("peter@gmail.com", None),
])
def test_ignore_reason(one, email, reason):
    assert one(ad.ignore_reason, [email]) == [reason]


def test_clean_and_category(one):
    assert one(ad.clean, ["(Info@OakCare.co.uk)."]) == ["info@oakcare.co.uk"]
    cases = {
        "hr": "HR", "christina": "HR", "talent": "Recruitment", "jobs": "Careers",
        "administrator": "Manager", "information": "Info", "reception": "General", "sales": "General",
        "myinfo": "General", "peopledirector": "HR", "hiring.manager": "Recruitment",
    }
    assert one(ad.category, [f"{u}@x.org" for u in cases]) == [f"{c} Email" for c in cases.values()]


def test_link_rules(one):
    hrefs = {"#top": False, "tel:1": False, "mailto:a@b.co": False, "JavaScript:x": False, "": False,
             "/x": True}
    assert one(pg.is_page_href, hrefs) == list(hrefs.values())
    stop = {"/news/contact": True, "/fire-prevention": True, "/postcode-team": True, "/contact": False}
    assert one(pg.is_stop_path, stop) == list(stop.values())


def test_navigation_reason(one):
    cases = {
        "net::ERR_NAME_NOT_RESOLVED at x": "Website not reachable (DNS lookup failed)",
        "Timeout 20000ms exceeded": "Website connection timed out",
        "net::ERR_CONNECTION_REFUSED": "Website refused connection",
        "Page crashed": "Page crashed", None: "",
    }
    assert one(navigation_reason, cases) == list(cases.values())


# Pieces that meet at word edges and in hosts; the standard library says what is right.
EDGES = ("info@x.org a.b@c-d.co.uk @ . é ́ ‌ ‍ ‿ ⃣ ² ½ ① _ - + x Z 9 ß Ⅷ ٣ 中 "
         "̧ [at] (dot)").split(" ") + [" ", "\n"]
HOSTS = ("a.org [ ] ::1 1:2:3:4:5:6:7:8 http:// // /p care.co.uk v1.x @ :80 1 www. 127.0.0.1 ftp:// "
         "sip: ;a ?q %e :: fe80::1:2").split(" ")


def made_of(parts, n, longest):
    rnd = random.Random(11)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, longest))) for _ in range(n)]


def test_addresses_at_word_edges(one):
    texts = made_of(EDGES, 4000, 9) + [
        "info@x.orǵ", "info@x.org‍", "‍info@x.org", "info@x.org²", "½info@x.org"]
    want = [re.findall(ADDRESS_PATTERN, t) for t in texts]
    assert one(ad.find_addresses, texts) == want
    assert sum(map(len, want)) > 500


def test_urls_that_cannot_be_parsed(one):
    cases = made_of(HOSTS, 4000, 7) + [
        "a.org[x", "care.co.uk]/p", "www.[x/y", "https://care[1].co.uk/", "ftp://a.org/x;y"]

    def parts(url):
        try:
            return urlparse(url)
        except ValueError:
            return None

    def blocked(url):
        first = parts(url)
        return first is None or not first.netloc and parts("http://" + url) is None

    def home(url):
        first = parts(url)
        whole = first if first and first.scheme and first.netloc else first and parts("https://" + url)
        return f"{whole.scheme}://{whole.netloc}/" if whole else url

    none = Rules(blocked_suffixes=(), blocked_domains=())
    assert one(lambda u: urls.is_blocked(u, none), cases) == [blocked(u) for u in cases]
    assert one(urls.homepage, cases) == [home(u) for u in cases]
    got = one(urls.path, cases)
    assert [g for g, u in zip(got, cases) if parts(u)] == [parts(u).path for u in cases if parts(u)]
    assert sum(map(blocked, cases)) > 300
