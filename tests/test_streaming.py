"""Incremental runs: batches, restart, snapshots."""

from pyspark.sql import functions as F

from contactline.plans.enrich import enrich, with_site_key
from contactline.sources.pages import PAGE_FETCH, stream_page_fetches
from contactline.streaming import incremental as inc
from contactline.streaming.store import KeyedTable

A = [(i, f"s{i % 3}.org", f"https://s{i % 3}.org/{'' if i < 3 else f'p{i}'}", 1,
      f"https://s{i % 3}.org/", 200, f"<p>m{i % 5}@s{i % 3}.org</p>", None) for i in range(9)]
B = [(20 + i, "s4.org", "https://s4.org/", 1, "https://s4.org/", 200, f"<p>m{i}@s4.org m1@s4.org", None)
     for i in range(2)]
C = [(40, "s3.org", "https://s3.org/", 1, "https://s3.org/", 200, "<p>info@s3.org</p>", None)]


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGE_FETCH).coalesce(1)


def located(spark):
    names = [(i + 1, f"n{i}", f"s{i % 5}.org") for i in range(10)]
    df = spark.createDataFrame(names, "service_num long, service_name string, website string")
    return with_site_key(df)


def test_distinct_addresses_over_restarts(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for rows in (A[:5], A[5:]):
        pages(spark, rows).write.mode("append").parquet(source)
    run = lambda: inc.append_new(
        inc.site_addresses(stream_page_fetches(spark, source, 1)), out, mark).awaitTermination()
    run()
    first = spark.read.parquet(out).drop("batch").collect()
    pages(spark, A[:2] + B).write.mode("append").parquet(source)
    run()
    run()
    both = spark.read.parquet(out).drop("batch").collect()
    want = {(r[1], f"m{r[0] % 5}@{r[1]}") for r in A}
    assert sorted(map(tuple, first)) == sorted(want)
    assert sorted(map(tuple, both)) == sorted(want | {("s4.org", "m0@s4.org"), ("s4.org", "m1@s4.org")})
    counts = inc.sites_with_addresses(spark.read.parquet(out))
    assert sum(r.n_addresses for r in counts.collect()) == len(both)


def test_new_sites(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    located(spark).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = lambda: inc.named_sites(spark.readStream.schema(schema).parquet(source))
    inc.append_new(stream(), out, mark).awaitTermination()
    located(spark).coalesce(1).write.mode("append").parquet(source)
    inc.append_new(stream(), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def results(spark, out):
    return spark.read.parquet(f"{out}/services_enriched").collect()


def in_one_run(spark, rows):
    services = located(spark)
    batch = enrich(
        services.select("service_num", "service_name", F.col("website").alias("service_website")),
        spark.createDataFrame([], "service_num long, rank int, link string"), pages(spark, rows))
    return batch.orderBy("service_num").drop("service_num").collect()


def test_snapshots_equal_the_batch_run(spark, tmp_path, monkeypatch):
    source, run, out = (str(tmp_path / n) for n in ("in", "run", "out"))
    services = located(spark)
    replayed = []
    whole = inc.renew_records

    def renew(spark_, located_, folder, first, last, rules):
        replayed.append((first, last))
        whole(spark_, located_, folder, first, last, rules)

    monkeypatch.setattr(inc, "renew_records", renew)
    stream = lambda: stream_page_fetches(spark, source, 1)
    for rows in (A[:4], A[4:], B):
        pages(spark, rows).write.mode("append").parquet(source)
    inc.run_with_snapshots(stream(), services, run, out, 2)
    assert replayed == [(0, 1), (2, 2)]  # the last batch has its snapshot too
    assert results(spark, out) == in_one_run(spark, A + B)
    pages(spark, C).write.mode("append").parquet(source)
    inc.run_with_snapshots(stream(), services, run, out, 2)
    assert replayed[2:] == [(3, 3)]
    last = spark.read.parquet(f"{run}/records/data").where("part = 6")
    assert [r.site_key for r in last.collect()] == ["s3.org"]  # no other site is replayed
    got = results(spark, out)
    assert got == in_one_run(spark, A + B + C)
    inc.run_with_snapshots(stream(), services, run, out, 2)
    assert len(replayed) == 3 and results(spark, out) == got


def keyed(spark, ids, value):
    rows = [(f"s{i}.org", value) for i in ids]
    return spark.createDataFrame(rows, "site_key string, value long")


def test_keyed_table(spark, tmp_path):
    """Random batches against a dictionary; ranges are rewritten and doubled on the way."""
    import random

    rnd = random.Random(1)
    newest = KeyedTable(spark, str(tmp_path / "n"), newest=True, ranges=2, most_parts=2, most_rows=9)
    whole = KeyedTable(spark, str(tmp_path / "w"), ranges=2, most_parts=2, most_rows=9)
    assert newest.version() == -1 and newest.read() is None
    latest, rows = {}, []
    for batch in range(7):
        ids = rnd.sample(range(40), 8 if batch != 3 else 0)
        for table in (newest, whole):
            if batch == 5:
                table.add(batch, keyed(spark, [1, 2], -1))  # is repeated below
            table.add(batch, keyed(spark, ids, batch))
        latest |= {f"s{i}.org": batch for i in ids}
        rows += [(f"s{i}.org", batch) for i in ids]
        assert newest.version() == batch
        assert sorted(map(tuple, newest.read().collect())) == sorted(latest.items())
        assert sorted(map(tuple, whole.read().collect())) == sorted(rows)
    some = keyed(spark, [1, 2, 3, 99], 0)
    assert {r.site_key: r.value for r in newest.read_keys(some).collect()} == {
        k: v for k, v in latest.items() if k in ("s1.org", "s2.org", "s3.org")}
    assert newest._current().ranges > 2
    # no more than two versions are kept
    assert newest._versions() == [5, 6]


def test_a_batch_reads_its_own_ranges_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ranges=2500)
    table.add(0, keyed(spark, range(10_000), 1))
    touched = keyed(spark, range(0, 10_000, 250), 1)  # 40 of them
    found = table.read_keys(touched)
    assert found.count() == 40
    files = found.inputFiles()
    total = sum(table._current().rows.values())
    assert total == 10_000 and spark.read.parquet(*files).count() < 0.02 * total


def test_state_does_not_grow_with_what_is_read(spark, tmp_path):
    """Each batch reads its own rows only, and rows of earlier batches are not written again."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "site_key string, value long"
    for batch in range(6):
        keyed(spark, [*range(10), 100 + batch], 1).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = inc.append_new(stream, out, str(tmp_path / "mark"))
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [11] * 6
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in progress] == [11, 1, 1, 1, 1, 1]
    assert spark.read.parquet(out).count() == 16
    assert "RocksDB" not in (spark.conf.get(inc._PROVIDER, None) or "")


def test_batches_of_a_page_stream_do_not_grow_with_the_tables(spark, tmp_path, monkeypatch):
    """Tables of many files are as many batches as small ones, and their files are enough for all tasks."""
    from contactline.plans import queries

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40)
    pages = spark.createDataFrame(pages.collect(), pages.schema)
    monkeypatch.setattr(queries, "FILE_LOADS", 5)
    batches = {}
    for times in (1, 8):
        more = pages.crossJoin(spark.range(times).withColumnRenamed("id", "k")).withColumn(
            "page_id", F.col("page_id") + F.col("k") * 10_000).drop("k")
        more.repartition(times).write.parquet(f"{tmp_path}/{times}/pages.parquet")
        seen = []
        stream = queries._page_stream(spark, f"{tmp_path}/{times}")
        stream.writeStream.foreachBatch(
            lambda batch, i: seen.append((len(batch.inputFiles()), batch.count()))).option(
            "checkpointLocation", f"{tmp_path}/mark{times}").trigger(availableNow=True).start(
            ).awaitTermination()
        batches[times] = len(seen)
        assert sum(n for _, n in seen) >= 40 * times
    assert 2 <= batches[8] <= queries.BATCHES and batches[1] >= 2
