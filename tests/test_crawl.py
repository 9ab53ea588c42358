"""Visits: homepage attempts, page budget, early end, reasons; then whole records."""

import pytest
from pyspark.sql import functions as F

from contactline.operators import contacts as ct
from contactline.operators import pages as pg
from contactline.plans.enrich import enrich, replay, until_complete, visited_pages
from contactline.rules import CATEGORIES, MAX_PAGES, Rules
from contactline.runtime import materialise
from contactline.sources import results as rs
from contactline.sources.pages import PAGE_FETCH, read_page_fetches

HOME = "https://oakcare.co.uk"
KEY = "oakcare.co.uk"


def load(i, path="/", html="<p>hi</p>", status=200, final=None, attempt=1, error=None, key=KEY):
    url = f"https://{key}{path}"
    return (i, key, url, attempt, final or url, status, html, error)


def parsed(spark, loads, rules=Rules()):
    return materialise(pg.parse_pages(spark.createDataFrame(loads, PAGE_FETCH), rules), "parsed")


def sites(spark, *keys):
    rows = [(k, f"https://{k}/") for k in keys or (KEY,)]
    return spark.createDataFrame(rows, "site_key string, base_url string")


def visits(spark, loads, rules=Rules(max_pages=MAX_PAGES)):
    fetches = parsed(spark, loads, rules)
    _, within = visited_pages(sites(spark), fetches, rules)
    seen, _, _ = until_complete(within, fetches, rules)
    return [(r.url, r.status) for r in seen.orderBy("page_seq").collect()]


TEAM = "".join(f'<a href="/team{i}">t</a>' for i in range(12))


def test_budget_without_redirects(spark):
    loads = [load(0, html=TEAM)] + [load(1 + i, f"/team{i}") for i in range(12)]
    assert visits(spark, loads) == [(f"{HOME}/", 200)] + [(f"{HOME}/team{i}", 200) for i in range(9)]


def test_budget_with_redirects(spark):
    loads = [load(0, html=TEAM)]
    loads += [load(1 + i, f"/team{i}", final=f"{HOME}/r{i}") for i in range(12)]
    assert len(visits(spark, loads)) == 6


def test_failed_loads_use_one_and_redirect_targets_are_passed_over(spark):
    loads = [load(0, html=TEAM), load(1, "/team0", html="", status=None, error="x"),
             load(2, "/team1", final=f"{HOME}/team2"), load(3, "/team3", html="", status=500)]
    got = visits(spark, loads)
    assert got[:5] == [(f"{HOME}/", 200), (f"{HOME}/team0", 404), (f"{HOME}/team1", 200),
                       (f"{HOME}/team3", 500), (f"{HOME}/team4", 404)]
    assert len(got) == 9  # home, one redirect that uses two, seven failures


def test_all_loads_count_without_a_budget(spark):
    many = "".join(f'<a href="/team{i}">t</a>' for i in range(40))
    loads = [load(0, html=many + SIX.format(d=KEY))]
    loads += [load(1 + i, f"/team{i}", html=f"m{i}@{KEY}") for i in range(40)]
    fetches = parsed(spark, loads)
    _, seen = visited_pages(sites(spark), fetches)
    assert [r.url for r in seen.where("has_html").orderBy("page_seq").collect()] == [
        f"{HOME}/", *(f"{HOME}/team{i}" for i in range(40))]
    assert seen.where("NOT has_html").count() == 10  # the common paths
    row, = replay(sites(spark), fetches).collect()
    assert row["n_addresses"] == 46
    row, = replay(sites(spark), fetches, Rules(max_pages=4)).collect()
    assert row["n_addresses"] == 9
    row, = replay(sites(spark), fetches, stop=True).collect()
    assert row["n_addresses"] == 6


def test_smaller_budget(spark):
    loads = [load(0, html=TEAM)] + [load(1 + i, f"/team{i}") for i in range(12)]
    assert len(visits(spark, loads, Rules(max_pages=4))) == 4


SIX = "hr@{d} talent@{d} jobs@{d} owner@{d} info@{d} desk@{d}"


def test_early_end(spark):
    loads = [load(0, html=f"{TEAM}{SIX.format(d=KEY)}"), load(1, "/team0", html="x@oakcare.co.uk")]
    assert len(visits(spark, loads)) == 1
    # six categories by foreign addresses, lost again when an own address turns up
    loads = [load(0, html=f"{TEAM}hr@{KEY}"), load(1, "/team0", html=SIX.format(d="other.org")),
             load(2, "/team1", html=SIX.format(d=KEY).replace("hr@", "x@")), load(3, "/team2")]
    assert [u for u, _ in visits(spark, loads)] == [f"{HOME}/", f"{HOME}/team0", f"{HOME}/team1"]
    # a redirect to the foreign domain makes its addresses own ones
    loads = [load(0, html=f"{TEAM}hr@{KEY}"), load(1, "/team0", html=SIX.format(d="other.org")),
             load(2, "/team1", final="https://www.other.org/"), load(3, "/team2")]
    assert len(visits(spark, loads)) == 3


def brute_first_complete(addresses, domains):
    """The rule on every prefix of pages, with plain sets."""
    from tests_rules import category_of, root_of

    last = max([s for s, _ in addresses] + [s for s, _ in domains])
    for upto in range(last + 1):
        mails = {e for s, e in addresses if s <= upto}
        own = {e for e in mails if root_of(e) in {d for s, d in domains if s <= upto}}
        if {category_of(e) for e in (own or mails)} == set(CATEGORIES):
            return upto
    return None


def test_first_complete_page_against_brute_force(spark):
    import random

    rng = random.Random(3)
    locals_ = ["hr", "talent", "jobs", "owner", "info", "desk"]
    cases, adr, dom = {}, [], []
    for n in range(150):
        a = [(rng.randrange(6), f"{rng.choice(locals_)}@{rng.choice(['a.org', 'b.org'])}")
             for _ in range(rng.randint(8, 40))]
        d = [(rng.randrange(6), rng.choice(["a.org", "b.org", "c.org"])) for _ in range(2)]
        cases[str(n)] = brute_first_complete(a, d)
        adr += [(str(n), s, e) for s, e in a]
        dom += [(str(n), x, min(s for s, y in d if y == x)) for x in {x for _, x in d}]
    got = ct.first_complete_page(
        spark.createDataFrame(adr, "site_key string, page_seq int, email string"),
        spark.createDataFrame(dom, "site_key string, root_domain string, first_seq int"),
    )
    assert {r.site_key: r.last_seq for r in got.collect()} == {
        k: v for k, v in cases.items() if v is not None}
    assert len({v for v in cases.values()}) > 3


@pytest.mark.parametrize("loads, reason", [
    ([], "Website not reachable"),
    ([load(0, html="", status=None)], "Website not reachable"),
    ([load(0, html=None, status=None, error="net::ERR_NAME_NOT_RESOLVED")],
     "Website not reachable (DNS lookup failed)"),
    ([load(0, html="", status=None, error="Timeout 20000ms exceeded"),
      load(1, html="", status=None, attempt=2, error="Page crashed")], "Website connection timed out"),
    ([load(0, html="", status=None, error="x"),
      load(1, html="", status=500, attempt=2, error="net::ERR_CONNECTION_REFUSED")],
     "Website refused connection"),
    ([load(0, status=403)], "Homepage returned HTTP 403"),
    ([load(0, status=202)], "Homepage returned HTTP 202"),
    ([load(0, status=404)], "Website pages not found (404)"),
    ([load(0, status=404), load(1, "/contact")], "No email found"),
    ([load(0, error="Page crashed")], "Page crashed"),
    ([load(0, error="Page crashed"), load(1, attempt=2, status=None)], "No email found"),
    ([load(0, error="Page crashed", status=403), load(1, attempt=2, status=None)],
     "Homepage returned HTTP 403"),
    ([load(0)], "No email found"),
    ([load(0, status=403, html="<a href='http://[x/'>y</a>")], "No email found"),
    ([load(0, html="noreply@oakcare.co.uk")], "No email found"),
])
def test_reasons(spark, loads, reason):
    fetches = parsed(spark, loads) if loads else parsed(spark, [load(9, key="elm.org")])
    row, = replay(sites(spark), fetches).collect()
    assert (row["Status"], row["Failure Reason"]) == ("Failed", reason)


MIXED = (
    "hr@oakcare.co.uk christina@oakcare.co.uk talent@oakcare.co.uk jobs@oakcare.co.uk "
    "administrator@oakcare.co.uk information@oakcare.co.uk reception@oakcare.co.uk "
    "sales@oakcare.co.uk mediation@oakcare.co.uk noreply@oakcare.co.uk (Info@OakCare.co.uk). "
    "peter@gmail.com gp@surgery.nhs.uk"
)


def test_contacts_of_a_site(spark):
    row, = replay(sites(spark), parsed(spark, [load(0, html=MIXED, status=403)])).collect()
    assert [row[c] for c in CATEGORIES] == [
        "christina@oakcare.co.uk, hr@oakcare.co.uk", "talent@oakcare.co.uk", "jobs@oakcare.co.uk",
        "administrator@oakcare.co.uk", "info@oakcare.co.uk, information@oakcare.co.uk",
        "reception@oakcare.co.uk, sales@oakcare.co.uk"]
    assert row["Status"] == "Success" and row["Failure Reason"] == "" and row["n_addresses"] == 9


def test_foreign_addresses_stay_when_there_are_no_own_ones(spark):
    row, = replay(sites(spark), parsed(spark, [load(0, html="peter@gmail.com, x@elm.org")])).collect()
    assert row["General Email"] == "peter@gmail.com, x@elm.org"


def test_a_large_site_keeps_all_its_addresses_in_order(spark):
    mails = spark.range(3000).select(
        F.lit("big.org").alias("site_key"),
        F.concat(F.chr(F.col("id") % 26 + 97), "id", F.lit("@big.org")).alias("email"))
    domains = spark.createDataFrame([("big.org", "big.org")], "site_key string, root_domain string")
    flagged = ct.flag_own_domain(mails.unionByName(mails), domains)
    row, = ct.contacts_by_site(flagged).collect()
    listed = [m for c in CATEGORIES for m in row[c].split(", ") if m]
    assert sorted(listed) == sorted({r.email for r in mails.collect()}) and row.n_addresses == 3000
    assert all(row[c].split(", ") == sorted(row[c].split(", ")) for c in CATEGORIES)
    assert ct.own_domain_first(flagged).where("kept").count() == 3000


SERVICES = [
    (1, "Oak", "oakcare.co.uk/about"), (2, "Oak 2", "https://www.oakcare.co.uk/"), (3, "Elm", None),
    (4, "Ash", "nan"), (5, "Fir", "https://www.yell.com/own"), (6, "Bad", "http://"),
]


def whole_run(spark):
    services = spark.createDataFrame(
        [(*r, None) for r in SERVICES],
        "service_num long, service_name string, service_website string, postcode string")
    results = spark.createDataFrame(
        [(1, 1, "https://no.org"), (3, 1, "https://www.yell.com/x"), (3, 2, "https://ELM.org/home"),
         (4, 1, "https://x.gov.uk")], "service_num long, rank int, link string")
    loads = [load(0, "/about", html=f"{TEAM}<p>info [at] oakcare.co.uk</p>"),
             load(1, "/team0", html="hr@oakcare.co.uk"), load(2, "/", html="unseen@oakcare.co.uk"),
             load(3, "/", html="<p>x@elm.org", key="elm.org"),
             load(4, "/", html="", status=None, key="yell.com", error="timed out")]
    return enrich(services, results, spark.createDataFrame(loads, PAGE_FETCH))


WANT = [
    (1, "Oak", "oakcare.co.uk/about", "hr@oakcare.co.uk", "", "", "", "info@oakcare.co.uk", "", "Success", ""),
    (2, "Oak 2", "https://www.oakcare.co.uk/", "hr@oakcare.co.uk", "", "", "", "info@oakcare.co.uk", "", "Success", ""),
    (3, "Elm", "https://ELM.org/", "", "", "", "", "", "x@elm.org", "Success", ""),
    (4, "Ash", "", "", "", "", "", "", "", "Failed", "Official website not found"),
    (5, "Fir", "https://www.yell.com/own", "", "", "", "", "", "", "Failed", "Website not reachable"),
    (6, "Bad", "http://", "", "", "", "", "", "", "Failed", "Website not reachable"),
]


@pytest.mark.parametrize("partitions", [1, 7])
def test_whole_run_for_any_number_of_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(tuple(r) for r in whole_run(spark).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == WANT


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_written_results(spark, tmp_path, fmt):
    out = str(tmp_path / "out")
    enriched = whole_run(spark)
    counts = rs.write_results(enriched, out, fmt)
    assert counts == {"total_rows": 6, "success_rows": 3, "failed_rows": 3}

    def read(name):
        reader = spark.read.options(header=True, escape='"') if fmt == "csv" else spark.read
        return reader.format(fmt).load(f"{out}/{name}")

    assert read("services_enriched").columns == list(rs.ENRICHED_COLUMNS)
    assert [r[0] for r in read("services_success").collect()] == ["Oak", "Oak 2", "Elm"]
    assert read("services_failed").columns == list(rs.FAILED_COLUMNS)
    assert [r["Failure Reason"] for r in read("services_failed").collect()] == [
        "Official website not found", "Website not reachable", "Website not reachable"]
    assert rs.status_counts(enriched).first() == (6, 3, 3)


def test_missing_columns_and_odd_statuses(spark):
    df = spark.createDataFrame(
        [(1, "a", " SUCCESS "), (2, "b", "failed"), (3, "c", "open"), (4, "d", None)],
        "service_num long, `Service Name` string, Status string")
    table = rs.enriched_table(df)
    assert table.columns[1:] == list(rs.ENRICHED_COLUMNS)
    assert rs.status_counts(table).first() == (4, 1, 1)
    assert rs.success_table(table).first()["Service Name"] == "a"
    assert table.where("`HR Email` = ''").count() == 4


def test_page_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([load(0)], PAGE_FETCH).write.parquet(path)
    assert read_page_fetches(spark, path).collect() == [load(0)]


def test_rules_and_blocklists_of_a_run(spark):
    services = spark.createDataFrame(
        [(1, "a", None, None), (2, "b", None, None)],
        "service_num long, service_name string, service_website string, postcode string")
    found = spark.createDataFrame(
        [(1, 1, "https://www.portal.org/a"), (1, 2, f"{HOME}/x"), (2, 1, "https://portal.org/b")],
        "service_num long, rank int, link string")
    loads = spark.createDataFrame([load(0, html="matron@oakcare.co.uk")], PAGE_FETCH)
    rules = Rules(category_words=(("Manager Email", ("matron",)),), info_prefix="x")
    listed = spark.createDataFrame([("portal.org",)], "domain string")
    rows = {r["service_num"]: r for r in enrich(services, found, loads, rules, blocklist=listed).collect()}
    assert rows[1]["Service Website"] == f"{HOME}/" and rows[1]["Manager Email"] == "matron@oakcare.co.uk"
    assert rows[2]["Failure Reason"] == "Official website not found"
