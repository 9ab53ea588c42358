"""Incremental runs: new page loads are parsed once, and results are renewed as they come.

Each query has its own checkpoint, so a run that is started again goes on where the last one
stopped. Loads and records are tables by site (``KeyedTable``), of which a batch reads and writes only
the ranges of its own sites. What a stream has brought before is keyed state of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contactline.operators.pages import page_addresses, parse_pages
from contactline.plans.enrich import assemble, replay, sites_of
from contactline.rules import DEFAULT_RULES, Rules
from contactline.runtime import materialise
from contactline.sources.results import write_results
from contactline.streaming.store import KeyedTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def loads_of(spark: SparkSession, folder: str, **how) -> KeyedTable:
    """Parsed page loads of a run by site."""
    return KeyedTable(spark, f"{folder}/loads", **how)


def records_of(spark: SparkSession, folder: str, **how) -> KeyedTable:
    """Latest record of each site of a run."""
    return KeyedTable(spark, f"{folder}/records", newest=True, **how)


def store_fetches(
    page_fetch: DataFrame,
    folder: str,
    rules: Rules = DEFAULT_RULES,
    after_batch: Callable[[SparkSession, int], None] | None = None,
) -> StreamingQuery:
    """Parse new page loads into the loads of ``folder``, then call ``after_batch``. The sites of
    each batch are noted under ``sites``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = materialise(parse_pages(batch, rules), "batch")
        parsed.select("site_key").distinct().write.mode("overwrite").parquet(
            f"{folder}/sites/batch={batch_id}")
        loads_of(spark, folder).add(batch_id, parsed)
        if after_batch is not None:
            after_batch(spark, batch_id)

    return (
        page_fetch.writeStream.foreachBatch(save)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def renew_records(
    spark: SparkSession, located: DataFrame, folder: str, first: int, last: int,
    rules: Rules = DEFAULT_RULES,
) -> None:
    """Records of the sites that loads of the batches ``first`` to ``last`` belong to, from all
    their loads. Of the loads only the ranges of these sites are read."""
    noted = [f"{folder}/sites/batch={b}" for b in range(first, last + 1)]
    touched = materialise(spark.read.parquet(*noted).select("site_key").distinct(), "touched")
    own = loads_of(spark, folder).read_keys(touched)
    if own is None:
        return
    sites = sites_of(located).join(touched, "site_key", "left_semi")
    records_of(spark, folder).add(last, replay(sites, own, rules))


def write_snapshot(spark: SparkSession, located: DataFrame, folder: str, out: str) -> None:
    """The three result tables from the latest record of each site.

    ``located`` are the services with ``website`` and ``site_key``; sites without loads so far have
    none and are not reachable.
    """
    latest = records_of(spark, folder).read()
    if latest is not None:
        write_results(materialise(assemble(located, latest), "snapshot"), out)


def run_with_snapshots(
    page_fetch: DataFrame, located: DataFrame, folder: str, out: str, n: int = 30,
    rules: Rules = DEFAULT_RULES,
) -> None:
    """Parses all new loads and renews the result tables after every ``n`` batches and at the end,
    also if the stream breaks off. ``folder`` holds loads, records and checkpoint."""
    spark = page_fetch.sparkSession
    done = records_of(spark, folder).version()

    def renew(batch_id: int) -> None:
        nonlocal done
        if batch_id > done:
            renew_records(spark, located, folder, done + 1, batch_id, rules)
            done = batch_id
            write_snapshot(spark, located, folder, out)

    def after_batch(_: SparkSession, batch_id: int) -> None:
        if (batch_id + 1) % n == 0:
            renew(batch_id)

    try:
        store_fetches(page_fetch, folder, rules, after_batch).awaitTermination()
    finally:
        renew(loads_of(spark, folder).version())


def site_addresses(page_fetch: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(site_key, email) of valid addresses of page loads, batch or stream."""
    return (
        page_addresses(parse_pages(page_fetch, rules), rules)
        .where("is_valid")
        .select("site_key", "email")
    )


def named_sites(services: DataFrame) -> DataFrame:
    """(site_key) of services that name a site; the first one's record serves the later ones."""
    return services.where("site_key IS NOT NULL").select("site_key")


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, unless the session names a store."""
    named = spark.conf.get(_PROVIDER, None)
    if named and not named.endswith("HDFSBackedStateStoreProvider"):
        yield
        return
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if named:
            spark.conf.set(_PROVIDER, named)
        else:
            spark.conf.unset(_PROVIDER)


def append_new(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write rows that the stream has not brought before, each once, to a folder for each batch.

    Rows met are keyed state of the stream: a batch looks up its own rows there, whatever came
    earlier, and a batch that is repeated starts from the state before it.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    with _state_on_disk(stream.sparkSession):
        return (
            stream.dropDuplicates().writeStream.foreachBatch(save)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def sites_with_addresses(pairs: DataFrame) -> DataFrame:
    """(site_key, n_addresses) of the pairs written so far."""
    return pairs.groupBy("site_key").agg(F.count("*").alias("n_addresses"))
