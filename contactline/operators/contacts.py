"""From judged addresses to contacts per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactline.functions.addresses import category, domain_part
from contactline.functions.urls import host_or_first_segment, root_domain
from contactline.operators.cells import PART, in_parts
from contactline.operators.skew import hot_key_left_join
from contactline.rules import (
    CATEGORIES,
    DEFAULT_RULES,
    FAILED,
    FAILURE_REASON,
    REASON_NO_ADDRESS,
    STATUS,
    SUCCESS,
    Rules,
)
from contactline.runtime import materialise

def site_domains(pages: DataFrame, url: str = "url") -> DataFrame:
    """Root domains of a site's page URLs, also of pages without content. A URL is looked at once,
    however many rows have it; unwritten, the optimizer would leave the first ``distinct`` out."""
    domain = root_domain(host_or_first_segment(F.col(url)))
    return (
        materialise(pages.select("site_key", url).distinct(), "site_urls")
        .select("site_key", domain.alias("root_domain"))
        .where(F.col("root_domain") != "")
        .distinct()
    )


def flag_own_domain(
    addresses: DataFrame, domains: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Distinct (site_key, email) with ``category``, ``root_domain`` and ``is_own``."""
    distinct = addresses.select("site_key", "email").distinct()
    email = F.col("email")
    labelled = materialise(distinct.withColumns(
        {"category": category(email, rules), "root_domain": root_domain(domain_part(email))}
    ), "labelled")
    own = domains.select("site_key", "root_domain").distinct().withColumn("_own", F.lit(True))
    return (
        hot_key_left_join(labelled, own, ["site_key", "root_domain"], ["email"])
        .withColumn("is_own", F.col("_own").isNotNull())
        .drop("_own")
    )


def own_domain_first(flagged: DataFrame) -> DataFrame:
    """Adds ``kept``: a site with addresses under its own domains keeps only those."""
    flagged = materialise(flagged, "flagged")
    with_own = (
        flagged.where("is_own").select("site_key").distinct().withColumn("_any", F.lit(True))
    )
    return (
        hot_key_left_join(flagged, with_own, ["site_key"], ["email"])
        .withColumn("kept", F.col("is_own") | F.col("_any").isNull())
        .drop("_any")
    )


def contacts_by_site(flagged: DataFrame) -> DataFrame:
    """One row per site with addresses: six category columns and their count.

    Each column is the sorted list of the site's addresses. It is built in two steps so that a
    large site is not gathered address by address: lists by first two characters, in parallel,
    then one short text per list; put together in the order of those characters they are sorted.
    Whether a site has own-domain addresses is known in the last step, which has both kinds.
    """
    start = F.substring("email", 1, 2)
    parts = flagged.groupBy("site_key", "category", "is_own", start.alias("start")).agg(
        F.array_join(F.sort_array(F.collect_list("email")), ", ").alias("part"),
        F.count("*").alias("n"),
    )

    def joined(name: str, own: bool) -> Column:
        here = (F.col("category") == name) & (F.col("is_own") == own)
        pieces = F.sort_array(F.collect_list(F.when(here, F.struct("start", "part"))))
        return F.array_join(F.transform(pieces, lambda p: p.part), ", ")

    sums = [
        F.bool_or("is_own").alias("any_own"),
        F.sum(F.when(F.col("is_own"), F.col("n"))).alias("n_own"),
        F.sum("n").alias("n_all"),
    ]
    lists = [
        joined(name, own).alias(f"{name} {own}") for name in CATEGORIES for own in (True, False)
    ]
    by_site = parts.groupBy("site_key").agg(*sums, *lists)
    return by_site.select(
        "site_key",
        *(
            F.when(F.col("any_own"), F.col(f"`{n} True`")).otherwise(F.col(f"`{n} False`")).alias(n)
            for n in CATEGORIES
        ),
        F.when(F.col("any_own"), F.col("n_own")).otherwise(F.col("n_all")).alias("n_addresses"),
    )


def contact_parts(flagged: DataFrame, size: int = PART) -> DataFrame:
    """``site_key, category, part, start, n, text``: what ``contacts_by_site`` has in one cell, in
    parts of at most ``size`` bytes, for sites with any number of addresses."""
    kept = own_domain_first(flagged).where("kept")
    return in_parts(kept, ["site_key", "category"], "email", size)


def contact_counts(flagged: DataFrame) -> DataFrame:
    """``site_key``, the number of addresses by category and ``n_addresses``: what goes with
    ``contact_parts``. Only sums by site are shuffled."""
    by_kind = flagged.groupBy("site_key").agg(
        F.bool_or("is_own").alias("any_own"),
        *(F.count_if((F.col("category") == n) & (F.col("is_own") == own)).alias(f"{n} {own}")
          for n in CATEGORIES for own in (True, False)))
    counts = [
        F.when(F.col("any_own"), F.col(f"`{n} True`")).otherwise(F.col(f"`{n} False`")).alias(n)
        for n in CATEGORIES
    ]
    total = sum((F.col(f"`{n}`") for n in CATEGORIES), F.lit(0).cast("long"))
    return by_kind.select("site_key", *counts).withColumn("n_addresses", total)


def site_records(sites: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row per site, found addresses or not, with status and reason.

    ``sites`` is (site_key, reason): why a site without addresses has none; null if not known.
    """
    any_address = F.coalesce(F.col("n_addresses"), F.lit(0)) > 0
    return sites.join(contacts, "site_key", "left").select(
        "site_key",
        *(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in CATEGORIES),
        F.coalesce("n_addresses", F.lit(0)).alias("n_addresses"),
        F.when(any_address, SUCCESS).otherwise(FAILED).alias(STATUS),
        F.when(any_address, "")
        .otherwise(F.coalesce(F.col("reason"), F.lit(REASON_NO_ADDRESS)))
        .alias(FAILURE_REASON),
    )


def all_categories_found() -> Column:
    """All six category columns are filled."""
    filled = F.lit(True)
    for name in CATEGORIES:
        filled = filled & (F.trim(F.col(f"`{name}`")) != "")
    return filled


def first_complete_page(
    addresses: DataFrame, domains: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """(site_key, last_seq): the first page after which all six categories are filled, if any.

    ``addresses`` is (site_key, page_seq, email) of valid addresses and ``domains`` is (site_key,
    root_domain, first_seq). The own-domain rule holds anew after every page. An address is there
    from its page on, and is an own one once a page of its domain was seen too. So the rule needs
    minima only: before the first own address every category counts from its first address,
    afterwards from its first own one.
    """
    email = F.col("email")
    # First pages by category and domain: what is joined does not grow with a site's addresses.
    rows = addresses.groupBy(
        "site_key", category(email, rules).alias("category"),
        root_domain(domain_part(email)).alias("root_domain"),
    ).agg(F.min("page_seq").alias("page_seq")).join(domains, ["site_key", "root_domain"], "left")
    own_from = F.when(F.col("first_seq").isNotNull(), F.greatest("page_seq", "first_seq"))
    per_category = rows.groupBy("site_key", "category").agg(
        F.min("page_seq").alias("any_from"), F.min(own_from).alias("own_from")
    )
    n = len(CATEGORIES)
    per_site = per_category.groupBy("site_key").agg(
        F.when(F.count("any_from") == n, F.max("any_from")).alias("any_all"),
        F.when(F.count("own_from") == n, F.max("own_from")).alias("own_all"),
        F.min("own_from").alias("own_start"),
    )
    before_own = F.col("own_start").isNull() | (F.col("any_all") < F.col("own_start"))
    last = F.when(before_own & F.col("any_all").isNotNull(), F.col("any_all")).otherwise(
        F.col("own_all")
    )
    return per_site.select("site_key", last.alias("last_seq")).where("last_seq IS NOT NULL")
