"""Replay of a site visit over a snapshot of fetched pages.

Tables here have one row per fetch, site or candidate, without page bodies. A *fetch* row is
(fetch_id, site_key, requested_url, attempt, final_url, status, error, has_html, found, links): see
``sources.pages`` and ``operators.pages.parse_pages``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactline.functions import urls
from contactline.functions.text import any_of
from contactline.operators.pages import STAGE_BROKEN, common_pages
from contactline.rules import (
    DEFAULT_RULES,
    ERROR_WORDS,
    REASON_ACCEPTED,
    REASON_FORBIDDEN,
    REASON_NO_ADDRESS,
    REASON_NOT_FOUND,
    REASON_UNREACHABLE,
    Rules,
)


def navigation_reason(error: Column) -> Column:
    """What an error of a page load means; other texts stay as they are, no error is empty."""
    text = F.lower(error)
    steps = F
    for reason, words in ERROR_WORDS.items():
        steps = steps.when(text.rlike(any_of(words)), reason)
    return steps.otherwise(F.coalesce(error, F.lit("")))


def page_status(status: Column, has_html: Column, missing: int | None) -> Column:
    """Status of a load without a response: 200 if there is a page all the same."""
    return F.coalesce(status, F.when(has_html, 200).otherwise(F.lit(missing).cast("int")))


def fetch_index(fetches: DataFrame) -> DataFrame:
    """One narrow row per (site_key, page_key, attempt); of copies the lowest fetch_id counts."""
    return (
        fetches.groupBy(
            "site_key", urls.canonical(F.col("requested_url")).alias("page_key"), "attempt"
        )
        .agg(F.min(F.struct("fetch_id", "final_url", "status", "error", "has_html")).alias("f"))
        .select("site_key", "page_key", "attempt", "f.*")
    )


def home_outcome(index: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per site: what opening its homepage led to.

    ``sites`` is (site_key, base_url). A second attempt counts if the first brought no page or an
    error, and if it brought a page or a response itself; then it stands for all but a missing
    status. A site without any homepage fetch is an unreachable one.
    """
    loads = sites.withColumn("page_key", urls.canonical(F.col("base_url"))).join(
        index.where(F.col("attempt").isin(1, 2)), ["site_key", "page_key"], "left"
    )
    load = F.struct(
        "fetch_id", "final_url", "status", "has_html", navigation_reason(F.col("error")).alias("reason")
    )
    both = loads.groupBy("site_key", "base_url").agg(
        F.max(F.when(F.col("attempt") == 1, load)).alias("first"),
        F.max(F.when(F.col("attempt") == 2, load)).alias("second"),
    )
    first_html = F.coalesce(F.col("first.has_html"), F.lit(False))
    second_html = F.coalesce(F.col("second.has_html"), F.lit(False))
    first_status = page_status(F.col("first.status"), first_html, None)
    again = ~first_html | (F.coalesce(F.col("first.reason"), F.lit("")) != "")
    second = again & (second_html | F.col("second.status").isNotNull())
    chosen = F.when(second, F.col("second")).otherwise(F.col("first"))
    return (
        both.withColumn("_c", chosen)
        .withColumn("_status", F.when(
            second, F.coalesce("second.status", first_status)).otherwise(first_status))
        .select(
            "site_key", "base_url",
            F.col("_c.fetch_id").alias("fetch_id"),
            F.col("_c.final_url").alias("final_url"),
            F.coalesce("_c.has_html", F.lit(False)).alias("has_html"),
            F.coalesce("_status", F.lit(200)).alias("status"),
            F.coalesce("_c.reason", F.lit("")).alias("reason"),
        )
    )


def candidates(homes: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(site_key, rank, url, page_key): pages to visit after the homepage, in order.

    ``homes`` is (site_key, base_url, final_url, links). Own links come first, those in a link zone
    before the others, then the common paths. The first appearance of a canonical URL counts. A
    site whose links cannot be read has one row with an empty url.
    """
    broken = F.exists("links", lambda x: x.stage == STAGE_BROKEN)
    everything = F.when(broken, F.col("links")).otherwise(
        F.concat("links", common_pages(F.col("base_url"), rules))
    )
    rows = (
        homes.select("site_key", "base_url", "final_url", F.explode_outer(everything).alias("c"))
        .where("c IS NOT NULL")
        .withColumn("page_key", urls.canonical(F.col("c.url")))
        .where(
            (F.col("page_key") != urls.canonical(F.col("base_url")))
            & (F.col("page_key") != urls.canonical(F.col("final_url")))
        )
    )
    first = rows.groupBy("site_key", "page_key").agg(F.min("c").alias("c"))
    order = Window.partitionBy("site_key").orderBy("c.stage", "c.pos")
    return (
        first.withColumn("rank", F.row_number().over(order))
        .select("site_key", "rank", F.col("c.url").alias("url"), "page_key")
    )


def _tried(planned: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates with their first load, ``f``, if there is one; whether it brought a page."""
    first_try = index.groupBy("site_key", "page_key").agg(
        F.min(F.struct("attempt", "fetch_id", "final_url", "status", "has_html")).alias("f")
    )
    return planned.join(first_try, ["site_key", "page_key"], "left").withColumn(
        "loaded", F.coalesce(F.col("f.has_html"), F.lit(False)))


def visit(
    homes: DataFrame, planned: DataFrame, index: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """(site_key, page_seq, fetch_id, url, final_url, status, has_html, broken): the pages visited.

    Page 0 is the homepage, and ``homes`` are the sites whose homepage loaded. Without a budget
    every candidate is a page, with its rank as number; with ``max_pages`` see ``budgeted``.
    """
    if rules.max_pages is not None:
        return budgeted(homes, planned, index, rules.max_pages)
    links_end = planned.where("url = ''").select("site_key", F.lit(True).alias("_broken")).distinct()
    broken = F.coalesce("_broken", F.lit(False)).alias("broken")
    first = homes.join(links_end, "site_key", "left").select(
        "site_key", F.lit(0).alias("page_seq"), "fetch_id", F.col("base_url").alias("url"),
        "final_url", "status", F.lit(True).alias("has_html"), broken)
    others = _tried(planned.where("url <> ''"), index).select(
        "site_key", F.col("rank").alias("page_seq"), "f.fetch_id", "url", "f.final_url",
        page_status(F.col("f.status"), F.col("loaded"), 404).alias("status"),
        F.col("loaded").alias("has_html"), F.lit(False).alias("broken"))
    return first.unionByName(others)


def budgeted(
    homes: DataFrame, planned: DataFrame, index: DataFrame, max_pages: int
) -> DataFrame:
    """``visit`` within a budget of ``max_pages`` canonical URLs per site.

    Walks each site's candidates in order until the URLs are used up: a loaded page uses its
    requested and its final one, a failed load one, and a candidate already used is passed over.
    Each visit uses up at least one URL and the homepage the first, so there are at most
    max_pages - 1 visits; a candidate is passed over only if it is the final URL of such a visit,
    at most once per visit. So candidates after twice that number are never looked at.
    """
    tried = _tried(planned.where(F.col("rank") <= max(2 * (max_pages - 1), 1)), index)
    loaded = F.col("loaded")
    step = F.struct(
        "rank", "url", "page_key",
        F.when(loaded, urls.canonical(F.col("f.final_url"))).otherwise(
            F.col("page_key")).alias("final_key"),
        F.col("f.fetch_id").alias("fetch_id"),
        F.col("f.final_url").alias("final_url"),
        page_status(F.col("f.status"), loaded, 404).alias("status"),
        loaded.alias("has_html"),
    )
    # at most 2 * (max_pages - 1) steps per site
    steps = tried.groupBy("site_key").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    walk = homes.join(steps, "site_key", "left")

    used = F.array_distinct(F.array(
        urls.canonical(F.col("final_url")), urls.canonical(F.col("base_url"))))
    start = F.struct(used.alias("used"), F.expr("cast(array() as array<int>)").alias("picked"))

    def follow(state, s):
        skip = (
            (F.size(state.used) >= max_pages)
            | F.array_contains(state.used, s.page_key)
            | (s.url == "")
        )
        return F.when(skip, state).otherwise(F.struct(
            F.array_union(state.used, F.array(s.page_key, s.final_key)).alias("used"),
            F.concat(state.picked, F.array(s["rank"])).alias("picked"),
        ))

    done = F.aggregate(F.coalesce("steps", F.expr("array()")), start, follow)
    home = F.struct(
        F.col("fetch_id"), F.col("base_url").alias("url"), F.col("final_url"),
        F.col("status"), F.lit(True).alias("has_html"),
    )
    others = F.transform(
        F.filter("steps", lambda s: F.array_contains(F.col("picked"), s["rank"])),
        lambda s: F.struct(s.fetch_id.alias("fetch_id"), s.url.alias("url"),
                           s.final_url.alias("final_url"), s.status.alias("status"),
                           s.has_html.alias("has_html")),
    )
    return (
        walk.withColumn("picked", done.picked)
        .withColumn("broken", F.coalesce(F.exists("steps", lambda s: s.url == ""), F.lit(False)))
        .select(
            "site_key", "broken",
            F.posexplode(F.concat(F.array(home), F.coalesce(others, F.expr("array()"))))
            .alias("page_seq", "p"),
        )
        .select("site_key", "page_seq", "p.*", "broken")
    )


def site_reasons(visited: DataFrame, homes: DataFrame) -> DataFrame:
    """(site_key, reason): why a site without any address has none.

    ``homes`` is the outcome of all sites, ``visited`` the visited pages of those that loaded.
    """
    statuses = visited.groupBy("site_key").agg(
        F.every(F.col("status") == 404).alias("all_404"), F.bool_or("broken").alias("broken")
    )
    loaded_reason = (
        F.when(F.col("broken"), REASON_NO_ADDRESS)
        .when(F.col("status") == 403, REASON_FORBIDDEN)
        .when(F.col("status") == 202, REASON_ACCEPTED)
        .when(F.col("all_404"), REASON_NOT_FOUND)
        .when(F.col("reason") != "", F.col("reason"))
        .otherwise(REASON_NO_ADDRESS)
    )
    failed_reason = F.when(F.col("reason") != "", F.col("reason")).otherwise(REASON_UNREACHABLE)
    return homes.join(statuses, "site_key", "left").select(
        "site_key",
        F.when(F.col("has_html"), loaded_reason).otherwise(failed_reason).alias("reason"),
    )
