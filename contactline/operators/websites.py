"""Which website belongs to a service: the given one, else the first allowed search result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactline.functions import urls
from contactline.functions.text import absent_to_null
from contactline.operators.skew import hot_key_left_join
from contactline.rules import DEFAULT_RULES, SEARCH_PHRASE, Rules
from contactline.runtime import materialise


def search_query(name: Column, postcode: Column) -> Column:
    """Text to search for: name, postcode where there is one, and the fixed phrase."""
    return F.concat_ws(" ", name, absent_to_null(postcode), F.lit(SEARCH_PHRASE))


def first_allowed_result(results: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(service_num, found_website): homepage of the best ranked link that is not blocked."""
    return (
        results.where((F.col("link") != "") & ~urls.is_blocked(F.col("link"), rules))
        .groupBy("service_num")
        .agg(F.min_by("link", "rank").alias("link"))
        .select("service_num", urls.homepage(F.col("link")).alias("found_website"))
    )


def without_listed_hosts(df: DataFrame, url: str, blocklist: DataFrame) -> DataFrame:
    """Rows whose host is not equal to or under a domain of a blocklist table (column ``domain``).

    For lists too long for an expression. Each distinct host is looked up once, by its suffixes,
    so this stays an equi join; the rows of a hot host are spread when the verdict comes back to them.
    """
    host = F.coalesce(urls.host_for_blocklist(F.col(url)), F.lit(""))
    keyed = materialise(df.withColumn("_host", host), "hosts")
    listed = (
        keyed.select("_host")
        .distinct()
        .select("_host", F.explode(urls.host_suffixes(F.col("_host"))).alias("domain"))
        .join(blocklist.select("domain").distinct(), "domain", "left_semi")
        .select("_host", F.lit(True).alias("_listed"))
        .distinct()
    )
    judged = hot_key_left_join(keyed, listed, ["_host"], df.columns)
    return judged.where(F.col("_listed").isNull()).select(*df.columns)


def choose_websites(
    services: DataFrame, results: DataFrame, rules: Rules = DEFAULT_RULES,
    blocklist: DataFrame | None = None,
) -> DataFrame:
    """Services with a ``website`` column; null where none is given and none was found. Only results
    of services without one are looked at."""
    given = absent_to_null(F.col("service_website"))
    searched = services.where(given.isNull()).select("service_num")
    wanted = results.join(searched, "service_num", "left_semi")
    if blocklist is not None:
        wanted = without_listed_hosts(wanted, "link", blocklist)
    return (
        services.join(first_allowed_result(wanted, rules), "service_num", "left")
        .withColumn("website", F.coalesce(given, "found_website"))
        .drop("found_website")
    )
