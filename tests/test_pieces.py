"""Delimited files read in pieces against the whole read by one task."""

import random

import pytest
from pyspark.sql import functions as F

from contactline.sources.services import _CSV, read_csv, read_services

CELLS = ["a", "", "b c", '"x, y"', '"two\nlines"', '"say ""hi"""', '""', '"a\n\n""b"",\nc"', 'half "quoted" cell',
         "5", "é", '"\n"', '"""\n"""', "it's", '"end"']


@pytest.fixture
def small_pieces(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "90")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def files(rnd, folder, n, line_end="\n", cells=CELLS):
    folder.mkdir()
    for k in range(n):
        rows = ["k,one,two"]
        for i in range(rnd.randint(15, 30)):
            rows.append(f"{k}-{i}," + ",".join(rnd.choice(cells) for _ in range(2)))
            if rnd.random() < 0.1:
                rows.append("")
        text = line_end.join(rows) + (line_end if k % 2 else "")
        (folder / f"f{k}.csv").write_bytes(text.encode("utf-8" if k % 3 else "latin-1"))
    return str(folder)


def whole(spark, path, encoding):
    return spark.read.options(**_CSV, multiLine=True, encoding=encoding).csv(path)


@pytest.mark.parametrize("seed,line_end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_rows_equal_the_whole_read(spark, tmp_path, small_pieces, seed, line_end):
    rnd = random.Random(seed)
    path = files(rnd, tmp_path / "in", 6, line_end)
    got = read_csv(spark, path)
    want = []
    for k in range(6):
        encoding = "UTF-8" if k % 3 else "ISO-8859-1"
        want += map(tuple, whole(spark, f"{path}/f{k}.csv", encoding).collect())
    rows = got.collect()
    assert sorted(map(repr, ((r.k, r.one, r.two) for r in rows))) == sorted(map(repr, want))
    # in the order of the file
    for k in range(6):
        own = sorted((r for r in rows if r.k.startswith(f"{k}-")), key=lambda r: (r._block, r._row))
        places = [int(r.k.partition("-")[2]) for r in own]
        assert places == sorted(places) and len({r._block for r in own}) > 1


def test_a_cell_over_many_pieces_and_an_open_quote(spark, tmp_path, small_pieces):
    path = tmp_path / "in"
    path.mkdir()
    long = "\n".join(f"line {i}" for i in range(200))
    (path / "a.csv").write_text(f'k,one\n1,"{long}"\n2,x\n3,"y\nz"\n')
    (path / "b.csv").write_text('k,one\n4,x\n5,"never\nclosed\n6,z\n7,"w"\n')
    got = sorted((r.k, r.one) for r in read_csv(spark, str(path)).collect())
    want = [tuple(r) for n in "ab" for r in whole(spark, str(path / f"{n}.csv"), "UTF-8").collect()]
    assert got == sorted(want) and ("1", long) in got


def test_services_are_numbered_in_file_order(spark, tmp_path, small_pieces):
    rows = [f'"Home {i}{chr(10) if i % 3 else " "}x",w{i}.org' for i in range(60)]
    (tmp_path / "s.csv").write_text("Provider Name,Website\n" + "\n".join(rows) + "\n")
    got = read_services(spark, str(tmp_path / "s.csv")).orderBy("service_num").collect()
    assert [r["Service Website"] for r in got] == [f"w{i}.org" for i in range(60)]
    assert [r["service_num"] for r in got] == list(range(1, 61))


def test_one_odd_quote_leaves_a_file_to_many_tasks(spark, tmp_path):
    n = 60_000
    path = tmp_path / "big.csv"
    with path.open("w") as f:
        f.write("k,one\n")
        for i in range(n):
            f.write(f'{i},"a\nb"\n' if i == 777 else f'{i},some text of a cell {i}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = read_csv(spark, str(path)).withColumn("_b", F.col("_block"))
        assert rows.count() == n and rows.select("_b").distinct().count() >= 9
        assert rows.where("k = '777'").first().one == "a\nb"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
