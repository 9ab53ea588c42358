"""Headers, row checks, numbering, and reading delimited files."""

import pytest
from pyspark.sql import functions as F

from contactline.operators import ingest as ig
from contactline.operators import websites as ws
from contactline.sources.search import search_results
from contactline.sources.services import read_raw, read_services


def test_header_mapping():
    assert ig.header_mapping(["Phone", "Provider_Name", "ServiceWebsite", "Post  Code", "Town / City"]) == {
        "Provider_Name": "Service Name", "ServiceWebsite": "Service Website",
        "Post  Code": "Postcode", "Town / City": "Town"}
    assert ig.header_mapping([" ORGANISATION "]) == {" ORGANISATION ": "Service Name"}
    assert ig.header_mapping(["Company", "Service Name"]) == {"Company": "Service Name"}
    with pytest.raises(ValueError, match="no service name column"):
        ig.header_mapping(["Foo", "Bar"])


def test_later_column_of_a_taken_name_is_dropped(spark):
    df = spark.createDataFrame([("a", "b")], "Company string, `Service Name` string")
    assert ig.map_headers(df).collect() == [("a",)]


ROWS = [("Oak Care", "oakcare.co.uk"), ("  Oak Care ", ""), ("", "x.com"), ("nan", ""), (None, ""),
        ("None", ""), ("Elm", "NaN")]


def test_row_checks_and_summary(spark):
    raw = spark.createDataFrame(ROWS, "`Service Name` string, `Service Website` string")
    raw = ig.null_tokens_to_null(raw)
    assert [r[0] for r in ig.valid_services(raw).collect()] == ["Oak Care", "Oak Care", "Elm"]
    assert ig.rejected_services(raw).count() == 4
    assert ig.load_summary(raw).first().asDict() == {
        "total": 3, "with_website": 1, "without_website": 2, "duplicates": 1, "invalid_skipped": 4}


def test_number_by_key(spark):
    df = spark.range(0, 1000, 7).repartition(5)
    got = {r.id: r.n for r in ig.number_by_key(df, "id", "n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(range(0, 1000, 7))}
    far = df.select((F.col("id") * 1_000_000_007 - 10**9).alias("id"))
    numbered = ig.number_by_key(far, "id", "n")
    assert [r.n for r in numbered.orderBy("id").collect()] == list(range(1, 144))
    assert "SinglePartition" not in numbered._jdf.queryExecution().toString()
    assert ig.number_by_key(df.limit(0), "id", "n").count() == 0


def test_parquet_services(spark, tmp_path):
    rows = [("b", 7), (" ", 1), ("a", 3)]
    path = str(tmp_path / "s.parquet")
    spark.createDataFrame(rows, "`Provider Name` string, place int").write.parquet(path)
    got = read_services(spark, path, order_by="place")
    assert sorted((r["service_num"], r["Service Name"]) for r in got.collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="no order"):
        read_services(spark, path)


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from contactline.runtime import shared_folder

    def session(master, named=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: named),
            sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
    assert shared_folder(session("yarn", "hdfs://host/tmp/")) == "hdfs://host/tmp"
    assert shared_folder(session("local[4]")) == shared_folder(session("local"))


def test_csv_folder(spark, tmp_path):
    head = "Provider_Name,Website,Website,,Post Code\n"
    (tmp_path / "a b.csv").write_bytes(
        (head + 'Zoë,"x.org",1,,N/A\n\n"Two\nlines, ""q""",  y.org ,2,,AB1\n').encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes((head + "Café,NULL,3,,Z\n ,z,4,,Z\nNone,z,5,,Z\n").encode("latin-1"))
    (tmp_path / "c.CSV").write_bytes((head + "Last,,6,,\n").encode())
    rows = {r.service_num: r for r in read_services(spark, str(tmp_path)).collect()}
    assert [rows[i]["Service Name"] for i in range(1, 5)] == ["Zoë", 'Two\nlines, "q"', "Café", "Last"]
    assert [rows[i]["Service Website"] for i in range(1, 5)] == ["x.org", "  y.org ", None, None]
    assert rows[1]["Postcode"] is None and rows[2]["Postcode"] == "AB1"
    assert {"Website.1", "Unnamed: 3"} <= set(rows[1].asDict())
    assert ig.load_summary(read_raw(spark, str(tmp_path))).first().invalid_skipped == 2


def test_csv_order_over_many_splits(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Service\n" + "".join(f"S{i}\n" if i % 3 else "\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = read_services(spark, str(path)).orderBy("service_num").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["Service Name"] for r in rows] == [f"S{i}" for i in range(1, 3001) if i % 3]
    assert [r.service_num for r in rows] == list(range(1, 2001))


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_services(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.txt").write_text("Service\na\n")
    with pytest.raises(ValueError, match="unsupported file type"):
        read_services(spark, str(tmp_path / "x.txt"))
    (tmp_path / "e.csv").write_text("Service\n")
    with pytest.raises(ValueError, match="is empty"):
        read_services(spark, str(tmp_path / "e.csv"))
    (tmp_path / "n.csv").write_text("Service,x\nnan,1\n")
    with pytest.raises(ValueError, match="no valid service records"):
        read_services(spark, str(tmp_path / "n.csv"))


def test_search(spark):
    body = '{"organic": [{"link": "https://www.yell.com/x"}, {"title": "t"}, ' \
           '{"link": "https://www.OakCare.co.uk:8443/homes/1?x=2"}, {"link": "https://elm.org"}]}'
    responses = spark.createDataFrame(
        [(1, body), (2, "{}"), (3, '{"organic": [{"link": "https://gov.uk/"}]}'), (4, body)],
        "service_num long, response string")
    services = spark.createDataFrame(
        [(1, "a", None), (2, "b", "nan"), (3, "c", ""), (4, "d", " https://www.yell.com/own ")],
        "service_num long, service_name string, service_website string")
    chosen = ws.choose_websites(services, search_results(responses))
    assert {r.service_num: r.website for r in chosen.collect()} == {
        1: "https://www.OakCare.co.uk:8443/", 2: None, 3: None, 4: "https://www.yell.com/own"}


def test_search_query(spark):
    df = spark.createDataFrame([("Oak Care", "AB1 2CD"), ("Oak Care", "nan"), ("Oak Care", None)], "n string, p string")
    got = [r[0] for r in df.select(ws.search_query(df.n, df.p)).collect()]
    assert got == ["Oak Care AB1 2CD official website"] + ["Oak Care official website"] * 2


def test_blocklist_table_agrees_with_the_expression(spark):
    from contactline.functions import urls
    from contactline.rules import BLOCKED_DOMAINS, BLOCKED_SUFFIXES

    links = spark.createDataFrame(
        [(u,) for u in ("https://a.yell.com/", "https://notyell.com", "x.gov.uk/y", "https://elm.org",
                        "https://yell.com:1/") * 20], "url string")
    table = spark.createDataFrame(
        [(d.lstrip("."),) for d in BLOCKED_DOMAINS + BLOCKED_SUFFIXES], "domain string")
    a = sorted(ws.without_listed_hosts(links, "url", table).collect())
    b = sorted(links.where(~urls.is_blocked(links.url)).collect())
    assert a == b and len(a) == 40
