"""Services, search results and fetched pages in; enriched services out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactline.functions import urls
from contactline.operators import contacts as ct
from contactline.operators import crawl as cr
from contactline.operators.pages import page_addresses, parse_pages
from contactline.operators.skew import hot_key_left_join
from contactline.operators.websites import choose_websites
from contactline.rules import (
    CATEGORIES,
    DEFAULT_RULES,
    FAILED,
    FAILURE_REASON,
    REASON_NO_WEBSITE,
    REASON_UNREACHABLE,
    SERVICE_NAME,
    SERVICE_WEBSITE,
    STATUS,
    Rules,
)
from contactline.runtime import materialise
from contactline.sources.results import enriched_table


def with_site_key(services: DataFrame, by: str = "root_domain") -> DataFrame:
    """Adds the key of the service's site; null without a website or a host in it."""
    key = urls.site_key(F.col("website"), by)
    return services.withColumn("site_key", F.when(key != "", key))


def sites_of(services: DataFrame) -> DataFrame:
    """(site_key, base_url): one website per site, that of the first service that names it."""
    return (
        services.where("site_key IS NOT NULL")
        .groupBy("site_key")
        .agg(F.min(F.struct("service_num", "website")).alias("s"))
        .select("site_key", urls.with_scheme(F.col("s.website")).alias("base_url"))
    )


def replay(
    sites: DataFrame, fetches: DataFrame, rules: Rules = DEFAULT_RULES, stop: bool = False
) -> DataFrame:
    """One record per site from a table of parsed fetches (see ``parse_pages``).

    All loads that the candidates lead to count. A budget (``rules.max_pages``) and ``stop``, the
    end of a visit at the page that fills all categories, save fetches where pages are yet to be
    fetched; here they only leave out what is there, so both are off unless asked for.
    """
    homes, visited = visited_pages(sites, fetches, rules)
    if stop:
        visited, addresses, domains = until_complete(visited, fetches, rules)
    else:
        addresses, domains = shown_addresses(visited, fetches, rules)
    flagged = ct.flag_own_domain(addresses, domains, rules)
    return ct.site_records(cr.site_reasons(visited, homes), ct.contacts_by_site(flagged))


def visited_pages(
    sites: DataFrame, fetches: DataFrame, rules: Rules = DEFAULT_RULES
) -> tuple[DataFrame, DataFrame]:
    """(outcome of every site's homepage, all pages visited).

    Both are small next to the pages and read by several later steps, so they are written.
    """
    index = cr.fetch_index(fetches)
    homes = materialise(cr.home_outcome(index, sites), "homes")
    loaded = homes.where("has_html")
    links = loaded.select("site_key", "base_url", "final_url", "fetch_id").join(
        fetches.select("fetch_id", "links"), "fetch_id"
    )
    planned = cr.candidates(links, rules)
    return homes, materialise(cr.visit(loaded, planned, index, rules), "visits")


def shown_addresses(
    visited: DataFrame, fetches: DataFrame, rules: Rules = DEFAULT_RULES
) -> tuple[DataFrame, DataFrame]:
    """Valid addresses (site_key, page_seq, email) and own domains (site_key, root_domain,
    first_seq) of visited pages."""
    found = page_addresses(fetches.select("fetch_id", "found"), rules).where("is_valid")
    shown = visited.where("has_html").select("site_key", "page_seq", "fetch_id")
    addresses = shown.join(
        found.select("fetch_id", "email").distinct(), "fetch_id"
    ).select("site_key", "page_seq", "email")
    domain = urls.root_domain(urls.host_or_first_segment(F.col("final_url")))
    domains = (
        visited.where("has_html")
        .groupBy("site_key", domain.alias("root_domain"))
        .agg(F.min("page_seq").alias("first_seq"))
        .where("root_domain != ''")
    )
    return addresses, domains


def until_complete(
    visited: DataFrame, fetches: DataFrame, rules: Rules = DEFAULT_RULES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visited pages, valid addresses and own domains, cut after the page that fills all
    categories."""
    addresses, domains = shown_addresses(visited, fetches, rules)
    last = ct.first_complete_page(addresses, domains, rules)

    def cut(df: DataFrame, seq: str) -> DataFrame:
        return (
            df.join(last, "site_key", "left")
            .where(F.col("last_seq").isNull() | (F.col(seq) <= F.col("last_seq")))
            .drop("last_seq")
        )

    return cut(visited, "page_seq"), cut(addresses, "page_seq"), cut(domains, "first_seq")


def assemble(services: DataFrame, records: DataFrame) -> DataFrame:
    """Services with their site's record; the website shown is the service's own.

    Many services may share a site, or have none: see ``hot_key_left_join``.
    """
    found = F.col("website").isNotNull()
    joined = hot_key_left_join(services, records, ["site_key"], ["service_num"])
    return enriched_table(joined.select(
        "service_num",
        F.col("service_name").alias(SERVICE_NAME),
        F.col("website").alias(SERVICE_WEBSITE),
        *CATEGORIES,
        F.coalesce(STATUS, F.lit(FAILED)).alias(STATUS),
        F.when(~found, REASON_NO_WEBSITE)
        .otherwise(F.coalesce(F.col(f"`{FAILURE_REASON}`"), F.lit(REASON_UNREACHABLE)))
        .alias(FAILURE_REASON),
    ))


def enrich(
    services: DataFrame,
    search_results: DataFrame,
    page_fetch: DataFrame,
    rules: Rules = DEFAULT_RULES,
    site_key: str = "root_domain",
    blocklist: DataFrame | None = None,
) -> DataFrame:
    """The whole run: (service_num, ten result columns), one row per service.

    services: service_num, service_name, service_website, postcode
    search_results: service_num, rank, link
    page_fetch: see ``sources.pages.PAGE_FETCH``
    blocklist: ``domain``, hosts that are never a found website, next to those of the rules
    """
    located = materialise(
        with_site_key(choose_websites(services, search_results, rules, blocklist), site_key),
        "located"
    )
    fetches = materialise(parse_pages(page_fetch, rules), "fetches")
    return assemble(located, replay(sites_of(located), fetches, rules))
