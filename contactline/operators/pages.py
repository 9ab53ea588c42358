"""From fetched pages to the addresses and links they hold: one parse per page, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactline.functions import addresses as ad
from contactline.functions import urls
from contactline.functions.html import page_parser
from contactline.functions.text import any_of, once
from contactline.operators.cells import PART, in_parts
from contactline.rules import DEFAULT_RULES, Rules
from contactline.runtime import bounded_batches

STAGE_BROKEN, STAGE_ZONE, STAGE_BODY, STAGE_COMMON = 0, 1, 2, 3


def is_page_href(href: Column) -> Column:
    """A link that can lead to a page."""
    return (href != "") & ~F.lower(href).rlike(r"\A(?:#|javascript:|mailto:|tel:)")


def same_site(url: Column, base: Column) -> Column:
    link_host, base_host = F.lower(urls.netloc(url)), F.lower(urls.netloc(base))
    return (link_host == base_host) | (urls.root_domain(link_host) == urls.root_domain(base_host))


def is_stop_path(path: Column, rules: Rules = DEFAULT_RULES) -> Column:
    if not rules.path_stop_words:
        return F.lit(False)
    return F.lower(path).rlike(any_of(rules.path_stop_words))


def is_relevant_link(text: Column, path: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """A wanted word in the link's text or path, and no stop word in its path."""
    wanted = any_of(rules.link_words)
    hit = F.lower(text).rlike(wanted) | F.lower(path).rlike(wanted)
    return hit & ~is_stop_path(path, rules)


def common_pages(base: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """The fixed paths on the site of ``base``, as link candidates of the last stage."""
    origin = F.concat(urls.scheme(base), F.lit("://"), urls.netloc(base))
    return F.filter(
        F.array(*(
            F.struct(F.lit(STAGE_COMMON).alias("stage"), F.lit(i).alias("pos"),
                     F.concat(origin, F.lit(p)).alias("url"))
            for i, p in enumerate(rules.common_paths)
        )),
        lambda c: ~is_stop_path(urls.path(c.url), rules),
    )


def relevant_links(links: Column, base: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Candidates of a page's own links; one row of stage 0 if a link cannot be parsed, since that
    ends the search for links on the site."""
    broken = F.array(F.struct(F.lit(STAGE_BROKEN).alias("stage"), F.lit(0).alias("pos"),
                              F.lit("").alias("url")))

    def staged(pages: Column) -> Column:
        kept = F.filter(
            pages,
            lambda x: same_site(x.url, base) & is_relevant_link(x.text, urls.path(x.url), rules),
        )
        found = F.transform(kept, lambda x: F.struct(
            F.when(x.in_zone, STAGE_ZONE).otherwise(STAGE_BODY).alias("stage"), x.pos.alias("pos"),
            x.url.alias("url")))
        return F.when(F.exists(pages, lambda x: x.url.isNull()), broken).otherwise(found)

    pages = F.filter(links, lambda x: is_page_href(x.href))
    return once(F.transform(pages, lambda x: F.struct(
        x.in_zone.alias("in_zone"), x.pos.alias("pos"), x.text.alias("text"),
        urls.resolve(base, x.href).alias("url"))), staged)


def found_addresses(page: Column, html: Column) -> Column:
    """Raw addresses of a parsed page by source, each once per source."""
    def tagged(values, source):
        return F.transform(F.array_distinct(values), lambda v: F.struct(
            F.lit(source).alias("source"), v.alias("raw")))

    mailtos = F.filter(F.transform(page.mailtos, ad.mailto_address), lambda v: v != "")
    return F.concat(
        tagged(mailtos, "mailto"),
        tagged(ad.find_addresses(html), "html"),
        tagged(ad.find_in_text(page.priority_text), "priority"),
        tagged(ad.find_in_text(page.visible_text), "text"),
    )


def parse_pages(pages: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Adds ``has_html``, ``found`` (addresses) and ``links`` (candidates); drops ``html``.

    A narrow operation on the scan: page bodies never cross a shuffle.
    """
    bounded_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rest = [c for c in pages.columns if c != "html"]
    return (
        pages.withColumn("html", html)
        .withColumn("_page", page_parser(rules)("html"))
        .select(
            *rest,
            (F.col("html") != "").alias("has_html"),
            found_addresses(F.col("_page"), F.col("html")).alias("found"),
            relevant_links(F.col("_page.links"), F.col("requested_url"), rules).alias("links"),
        )
    )


def judge(rows: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Adds ``email`` (cleaned), ``is_valid`` and ``ignore_reason`` to rows with a ``raw`` address."""
    return (
        rows.withColumn("email", ad.clean(F.col("raw")))
        .withColumn("ignore_reason", ad.ignore_reason(F.col("email"), rules))
        .withColumn("is_valid", F.col("ignore_reason").isNull())
    )


def page_addresses(parsed: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row per raw address of a page, judged."""
    rest = [c for c in parsed.columns if c not in ("found", "links")]
    # inline would have the optimizer test the list for being empty, and so compute it twice
    rows = parsed.select(*rest, F.inline_outer("found")).where("raw IS NOT NULL")
    return judge(rows, rules)


def _ignored() -> Column:
    """An ignored address and its reason as one text; null for a valid one."""
    return F.when(~F.col("is_valid"), F.concat(
        F.lit("'"), "email", F.lit("' ("), "ignore_reason", F.lit(")")))


def page_report_parts(judged: DataFrame, keys: list[str], size: int = PART) -> DataFrame:
    """``keys, valid, part, start, n, text``: the two cells of ``page_report`` in parts of at most
    ``size`` bytes, for pages with any number of addresses."""
    entries = judged.select(
        *keys, F.col("is_valid").alias("valid"),
        F.when(F.col("is_valid"), F.col("email")).otherwise(_ignored()).alias("entry"))
    return in_parts(entries, [*keys, "valid"], "entry", size)


def page_report(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: sorted valid addresses, and the ignored ones with their reasons."""
    ignored = _ignored()
    sets = judged.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.when(F.col("is_valid"), F.col("email")))).alias("valid"),
        F.sort_array(F.collect_set(ignored)).alias("invalid"),
    )
    return sets.select(
        *keys,
        F.array_join("valid", ", ").alias("found"),
        F.array_join("invalid", ", ").alias("ignored"),
        F.size("valid").alias("n_found"),
        F.size("invalid").alias("n_ignored"),
    )
