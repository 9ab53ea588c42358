"""URL filter by association rules.

Labelled pages give transactions of URL tokens (host suffixes, path words, file ending, query keys);
a page whose document is marked bad has the item ``!block`` too. Tokens that always occur together are
one item. Spark's FP-growth mines frequent combinations, those with ``!block`` become rules if confidence and support are high enough and no
shorter rule is as good, and an inverted index from a rule's rarest item finds the pages that a rule
fits. Given rules (host and path) come before mined ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactline.runtime import materialise

BLOCK_ITEM = "!block"
#: Names of tokens, or token sets that rules fit, which may be sent to every task; more are joined.
BROADCAST_ROWS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; numbers in paths are one token, an empty URL has none."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, n - i + 1), ".")))
    segments = F.transform(
        F.filter(F.split(path(url), "/"), lambda s: s != ""),
        lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, r"\d+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda s: s != ""),
        lambda s: F.concat(F.lit("query:"), F.substring_index(s, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)))
    found = F.array_sort(F.array_distinct(F.concat(scheme, suffixes, segments, keys)))
    return F.when(F.instr(url, "://") > 0, found).otherwise(
        F.expr("cast(array() as array<string>)"))


def given_rule(host_: Column, path_: Column, rules: dict[str, str]) -> Column:
    """The longest given rule (``host/path``) that fits, else null. The list is a setting, so it
    becomes one expression."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        of_host, slash, rest = rule.partition("/")
        on_host = (host_ == of_host) | host_.endswith("." + of_host)
        fits.append(F.when(on_host & path_.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _small(df: DataFrame) -> DataFrame:
    """A written table, sent to every task if it is below BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bundles(transactions: DataFrame, least: float) -> DataFrame:
    """``token, name`` of the tokens in at least ``least`` transactions (``id, tokens``): tokens that
    occur in the same transactions only have one name, the first of them.

    Such tokens are told by how many transactions they have and by 128 bits over their numbers, so
    nothing but sums by token is shuffled. A URL that is frequent as a whole is one name and not as
    many combinations as its tokens have.
    """
    found = transactions.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("a"),
        F.bit_xor(F.xxhash64("id", F.lit("again"))).alias("b"),
    ).where(F.col("n") >= least)
    name = F.min("token").over(Window.partitionBy("n", "a", "b"))
    return materialise(found.select("token", name.alias("name")), "bundles")


def named(sets: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """``key, names`` (sorted, distinct) of rows ``key, tokens``; rows without a named token go."""
    return sets.select(F.col(key), F.explode("tokens").alias("token")).join(
        _small(names), "token").groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("names"))


def mine(
    labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6,
) -> tuple[DataFrame, DataFrame]:
    """Rules ``names, n, confidence, support`` from ``tokens, bad``, and ``token, name`` (see
    ``bundles``). A rule stands for every choice of one token per name.

    A combination is dropped if a part of it is a rule of at least its confidence. With nothing
    labelled, or nothing marked bad, there are no rules.
    """
    spark = labelled.sparkSession
    known = materialise(labelled.where(F.size("tokens") > 0).select(
        "tokens", "bad", F.monotonically_increasing_id().alias("id")), "labelled")
    total = known.count()
    names = bundles(known, min_support * total)
    if names.isEmpty():
        return spark.createDataFrame(
            [], "names array<string>, n long, confidence double, support double"), names
    items = F.when(F.col("bad"), F.array_append("names", F.lit(BLOCK_ITEM))).otherwise(F.col("names"))
    # Transactions without a frequent token count for the support of the others.
    none = F.expr("cast(array() as array<string>)")
    transactions = known.select("id", "bad").join(named(known, "id", names), "id", "left").withColumn(
        "names", F.coalesce("names", none)).select(items.alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(
        transactions)
    sets = materialise(
        model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    without = F.array_remove("items", BLOCK_ITEM)
    with_block = sets.where(
        F.array_contains("items", BLOCK_ITEM) & (F.size("items") > 1)
    ).select(without.alias("items"), F.col("freq").alias("n"))
    # array_sort of names puts "!block" first, so what is left stays sorted and joins by value.
    rules = with_block.join(sets, "items").select(
        F.col("items").alias("names"), "n", (F.col("n") / F.col("freq")).alias("confidence"),
        (F.col("n") / F.lit(total)).alias("support"),
    ).where(F.col("confidence") >= min_confidence)
    rules = materialise(rules, "rules")
    parts = F.transform("names", lambda t: F.array_remove(F.col("names"), t))
    shorter = rules.select(F.col("names").alias("_part"), F.col("confidence").alias("_c"))
    beaten = (
        rules.select("names", "confidence", F.explode(parts).alias("_part"))
        .join(shorter, "_part").where(F.col("_c") >= F.col("confidence")).select("names").distinct()
    )
    return materialise(rules.join(beaten, "names", "left_anti"), "pruned_rules"), names


def fitting(sets: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """``tokens`` (distinct sets) to ``tokens, confidence``: the best rule that fits each, found by
    the rule's rarest name, so a set meets only rules whose rarest name it has."""
    of_sets = materialise(named(sets, "tokens", names), "named_sets")
    distinct = of_sets.select("names").distinct()
    frequency = rules.select(F.explode("names").alias("name")).distinct()
    rank = distinct.select(F.explode("names").alias("name")).groupBy("name").agg(
        F.count("*").alias("_sets")).join(frequency, "name")
    index = (
        rules.select("names", "confidence", F.explode("names").alias("name"))
        .join(rank, "name")
        .groupBy("names").agg(
            F.min(F.struct("_sets", "name"))["name"].alias("name"),
            F.first("confidence").alias("confidence"))
        .select("name", F.col("names").alias("_rule"), "confidence")
    )
    hits = distinct.select("names", F.explode("names").alias("name")).join(index, "name").where(
        F.size(F.array_except("_rule", "names")) == 0)
    best = hits.groupBy("names").agg(F.max("confidence").alias("confidence"))
    return of_sets.join(best, "names").select("tokens", "confidence")


def judge(
    pages: DataFrame, labelled: DataFrame, rules: dict[str, str] | None = None,
    min_support: float = 0.002, min_confidence: float = 0.6,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` for every row of ``pages``.

    ``labelled``: ``url, bad``; rows without a label do not count. A given rule decides; else a page
    is blocked if a mined rule fits. Null or odd URLs have empty host and path and are allowed;
    repeated rows are judged alike, empty tables give no rows.
    """
    rules = rules or {}
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    known = labelled.where(F.col("bad").isNotNull()).select(tokens(F.col("url")).alias("tokens"), "bad")
    mined, names = mine(known, min_support, min_confidence)
    read = pages.select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
        F.coalesce(tokens(F.col("url")), F.expr("cast(array() as array<string>)")).alias("tokens"),
    )
    sets = read.select("tokens").distinct()
    found = _small(materialise(fitting(sets, mined, names), "fitting"))
    rule = given_rule(F.col("host"), F.col("path"), rules)
    said = F.lit(None).cast("string")
    if rules:
        said = reduce(
            lambda so_far, r: so_far.when(F.col("rule") == r, F.lit(rules[r])),
            list(rules)[1:], F.when(F.col("rule") == list(rules)[0], F.lit(rules[list(rules)[0]])))
    return read.join(found, "tokens", "left").select(
        "page_id", "host", "path", rule.alias("rule"), "confidence"
    ).select(
        "page_id", "host", "path", "rule",
        F.coalesce(said, F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise("allow"))
        .alias("verdict"),
        "confidence",
    )
