"""Chat windows, URL rules, section tokens, archives, mixing and vector links against brute force."""

import base64
import hashlib
import itertools
import math
import random

import brute
import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from contactline.llm import chat, embeddings, mixing, queries, tokens, urls, warc
from contactline.runtime import new_folder

SF = "/root/testdata/sf0.001"
ODD = r"\### Assistant: </turn> ok"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- chat windows


def conversations():
    rnd = random.Random(1)
    bad = [ODD, "<turn>", "</turn>\n", r"<\turn:text>x</\\turn>", "<turn:again>", "", None, "<<//\\turn"]
    rows = []
    for conv in (1, 2, 3, None):
        for turn in range(600 if conv == 3 else 30):
            role = "system" if turn == 0 and conv != 1 else rnd.choice(["user", "assistant"])
            text = " ".join(rnd.choice(["hé", "wörd", *[b for b in bad if b]])
                            for _ in range(rnd.choice([0, 3, 9, 60])))
            rows.append((conv, turn, role, rnd.choice([text, text, rnd.choice(bad)])))
    rows += [(2, 5, "user", "same"), (2, 5, "user", "same"), (2, None, None, "first"),
             (4, 0, "assistant", ODD), (5, 0, "system", "only"), (6, 0, "<turn:text>", "r")]
    return rows


@pytest.mark.parametrize("budget,history", [(64, 0), (64, 20), (1024, 128)])
def test_chats_round_trip(spark, budget, history):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "window", F.lit("clash"))
    windows = chat.format_chats(df, budget, history)
    got = {r["conv_id"]: r for r in chat.digest(windows).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append(
            ((turn is not None, turn or 0), role or "", text or ""))
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0][0] and t[0][1] >= 0 and t[0][1] // chat.BLOCK, *t))
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha(said), conv
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), sha(learnt))
    assert set(got) == set(by_conv)
    for w in windows.collect():
        targets = w["formatted"].count(chat.NEW)
        # only one turn and the system turn can be more than the budget
        assert w["n_tokens"] <= budget or (targets == 1 and w["formatted"].count(chat.AGAIN) <= 1)
        spans = [w["formatted"][s["start"]: s["start"] + s["length"]] for s in w["loss"]]
        assert all(chat.END.strip() not in s for s in spans)
    if history:
        assert any(chat.AGAIN in w["formatted"] for w in windows.collect())


def test_windows_keep_to_the_budget_whatever_the_system_turn(spark):
    rnd, rows, longest = random.Random(3), [], {}
    for conv in range(60):
        sizes = [rnd.randrange(80), *[rnd.randrange(1, 25) for _ in range(30)]]
        longest[conv] = (sizes[0] + 4, max(sizes[1:]) + 4)
        rows += [(conv, t, "system" if t == 0 else ["user", "assistant"][t % 2], "w " * n)
                 for t, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    over = 0
    for w in chat.format_chats(df, 64, 20).collect():
        system, turn = longest[w["conv_id"]]
        if system >= 64:
            assert w["n_tokens"] <= system + 64
        elif w["n_tokens"] > 64:
            over += 1
            assert system + turn > 64 and w["formatted"].count(chat.NEW) == 1
            assert w["n_tokens"] <= system + turn
    assert over


def test_no_chats(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_chats(df)).count() == 0


def test_chat_query_has_the_odd_conversation(spark):
    r = queries.op2_chat_windows(spark, SF).where("conv_id = -7").first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(ODD), sha(ODD))
    assert r["turns_sha256"] == sha(f"user\n{ODD}\nassistant\n{ODD}\n")


# ---- URL rules


def test_hosts_paths_and_given_rules(spark):
    cases = {
        None: ("", "", None), "no scheme": ("", "", None), "": ("", "", None),
        "http://A.Example.COM": ("a.example.com", "", None),
        "http://example.com/En/x": ("example.com", "/En/x", "com/"),
        "HTTP://www.example.com/en/?q#f": ("www.example.com", "/en/", "www.example.com/en/"),
        "https://m.www.example.com/en/1": ("m.www.example.com", "/en/1", "www.example.com/en/"),
        "https://b.example.com/en/1": ("b.example.com", "/en/1", "example.com/en/"),
        "x://notexample.com/en/": ("notexample.com", "/en/", "com/"),
        "a://com?x://y.net/es/": ("com", "", None),
        "ftp://q.net/es/a?b": ("q.net", "/es/a", "net/es/"),
        "s://q.org/es/": ("q.org", "/es/", None), "é://Ö.NET/fr/\n": ("Ö.net", "/fr/\n", "net/fr/"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    labelled = spark.createDataFrame([], "url string, bad boolean")
    got = {r["page_id"]: r for r in urls.judge(pages, labelled, queries.URL_RULES).collect()}
    for i, (host, path, rule) in enumerate(cases.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), list(cases)[i]
        assert r["verdict"] == (queries.URL_RULES[rule] if rule else "allow")
    assert urls.judge(pages.limit(0), labelled, queries.URL_RULES).count() == 0


def spelled_out(rules, names):
    """Rules for every choice of one token per name."""
    members = {}
    for r in names.collect():
        members.setdefault(r["name"], []).append(r["token"])
    return {
        tuple(sorted(choice)): r["confidence"] for r in rules.collect()
        for choice in itertools.product(*(members[n] for n in r["names"]))}


def test_tokens_that_always_occur_together(spark):
    """Rules for one name of them are those that all of them would have."""
    rnd = random.Random(4)
    made = []
    for _ in range(250):
        shape = rnd.choice(["m.a.org/x/y", "m.a.org/x/y/z", "b.org/z", "b.org/x/y", "c.net/q/r"])
        made.append((f"s://{shape}", rnd.random() < (0.9 if "y" in shape else 0.2)))
    labelled = spark.createDataFrame(made, "url string, bad boolean")
    known = labelled.select(urls.tokens(F.col("url")).alias("tokens"), "bad")
    sets = [(set(r["tokens"]), r["bad"]) for r in known.collect()]
    want = brute.apriori(sets, 0.05, 0.6)
    rules, names = urls.mine(known, 0.05, 0.6)
    assert names.select("name").distinct().count() < names.count()
    assert spelled_out(rules, names) == pytest.approx(want)
    shapes = ["m.a.org", "a.org/y", "a.org/x", "x.org/y/q", "c.net/q", "c.net/r/z", "org/z", "b.org/x/z"]
    pages = spark.createDataFrame([(i, f"s://{u}") for i, u in enumerate(shapes)], "page_id long, url string")
    has = {r["page_id"]: set(r["t"]) for r in pages.select(
        "page_id", urls.tokens(F.col("url")).alias("t")).collect()}
    for r in urls.judge(pages, labelled, min_support=0.05).collect():
        fits = [v for k, v in want.items() if set(k) <= has[r["page_id"]]]
        assert r["confidence"] == (pytest.approx(max(fits)) if fits else None), shapes[r["page_id"]]


def test_a_frequent_url_of_many_parts(spark):
    """Forty parts that occur together are not 2 ** 40 combinations."""
    long = "s://h.org/" + "/".join(f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    made = [(long, True)] * 8 + [(f"s://h{i % 9}.net/q{chr(97 + i % 7)}", i % 5 == 0) for i in range(400)]
    labelled = spark.createDataFrame(made, "url string, bad boolean")
    pages = spark.createDataFrame(
        [(1, long), (2, "s://h.org/paa/other"), (3, "s://h1.net/qa")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labelled).collect()}
    assert got[1] == got[2] == "block"


def test_mined_rules_are_those_of_apriori(spark):
    rnd = random.Random(3)
    made = []
    for _ in range(300):
        host = rnd.choice(["a", "b", "c"])
        path = rnd.choice(["x", "y"])
        chance = {("a", "x"): 0.95, ("b", "x"): 0.7, ("b", "y"): 0.7}.get((host, path), 0.1)
        made.append((f"http://{host}/{path}", rnd.random() < chance))
    made += [(None, True), ("http://a/x", None)]
    labelled = spark.createDataFrame(made, "url string, bad boolean")
    known = labelled.where("bad is not null").select(urls.tokens(F.col("url")).alias("tokens"), "bad")
    rules = spelled_out(*urls.mine(known, 0.05, 0.6))
    sets = [({"scheme:http", f"host:{u[7]}", f"path:{u[9]}"}, b) for u, b in made[:-2]]
    want = brute.apriori(sets, 0.05, 0.6)
    assert rules == pytest.approx(want) and rules
    pages = spark.createDataFrame(
        [(i, f"http://{h}/{p}") for i, (h, p) in enumerate([(h, p) for h in "abcd" for p in "xyz"])],
        "page_id long, url string")
    for r in urls.judge(pages, labelled, min_support=0.05).collect():
        has = {"scheme:http", f"host:{r['host']}", f"path:{r['path'][1:]}"}
        fits = [v for k, v in want.items() if set(k) <= has]
        assert r["verdict"] == ("block" if fits else "allow")
        assert r["confidence"] == (pytest.approx(max(fits)) if fits else None)


# ---- tokens of sections


def encoded(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False)


def test_line_tokens_against_another_encoder(spark):
    texts = ["plain words\nand more\n\n  of them", "naïve ﬁ 中文 😀 end\n😀", "", None, "\n\n", "a" * 3000,
             "<|endoftext|> it's\t\tso"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = tokens.attribute(df).collect()
    for i, t in enumerate(texts):
        t = t or ""
        rows = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["section"])
        lines = t.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + lines[-1:]
        assert [t[r["start"]: r["end"]] for r in rows] == lines
        assert sum(r["n_tokens"] for r in rows) == rows[0]["doc_tokens"] == len(encoded(t).ids)
        starts = [o[0] for o in encoded(t).offsets]
        if t.isascii():
            assert [r["n_tokens"] for r in rows] == [
                sum(r["start"] <= s < r["end"] for s in starts) for r in rows]


def test_long_runs_are_cut_where_the_pattern_cuts(monkeypatch):
    import random

    with open(tokens.VOCABULARY, "rb") as f:
        encoder, whole, _ = tokens._encoder(f.read())
    monkeypatch.setattr(tokens, "LONG_RUN", 2)
    rnd = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", "a", "word", "7", "!", "'s", "é", "\x1c", "\u200b"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
        assert tokens.encoded(encoder, whole, text) == encoder.encode_ordinary(text), text


def test_ten_megabytes_of_one_sign(spark):
    n = 10_000_000
    df = spark.createDataFrame([(1, " "), (2, "a"), (3, "!"), (4, "\n")], "doc_id long, c string")
    df = df.select("doc_id", F.concat(F.repeat("c", F.lit(n)), F.lit("x")).alias("text"),
                   F.expr(f"array(named_struct('section', 0, 'start', 0, 'end', {n + 1}))").alias("s"))
    found = {r.doc_id: r for r in tokens.attribute(df.repartition(4), sections="s").collect()}
    assert set(found) == {1, 2, 3, 4}
    assert all(r.n_tokens == r.doc_tokens > n // 100 for r in found.values())


def test_boundary_rules(spark):
    text = "hello wonderful world"  # tokens: hello| wonderful| world
    spans = [{"section": 0, "start": 0, "end": 8}, {"section": 1, "start": 8, "end": 21},
             {"section": 2, "start": 0, "end": 21}, {"section": 3, "start": 4, "end": 4},
             {"section": None, "start": -5, "end": 99}]
    df = spark.createDataFrame(
        [(1, text, spans), (2, text, None)],
        "doc_id long, text string, s array<struct<section:int,start:int,end:int>>")
    got = {}
    for rule in tokens.RULES:
        rows = tokens.attribute(df, sections="s", rule=rule).collect()
        assert {r["doc_id"] for r in rows} == {1}
        got[rule] = [r["n_tokens"] for r in rows]
        assert [r["crossing"] for r in rows] == [1, 1, 0, 0, 0]
    assert got["start"] == [2, 1, 3, 0, 3] and got["end"] == [1, 2, 3, 0, 3]
    assert got["share"] == pytest.approx([1.3, 1.7, 3, 0, 3])
    assert tokens.attribute(df.limit(0)).count() == 0


# ---- archives


RECORD = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2"
          "\r\n\r\nab\r\n\r\n")


def archived(spark, rows, parts=1, least=0):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(parts)
    folder = new_folder(spark, "warc")
    warc.write_archives(df, folder, least)
    return [r.asDict() for r in warc.read_archives(spark, folder).collect()]


def test_archives_round_trip(spark):
    rows = [
        (1, "u", "hello"), (2, None, "hello"), (3, "u\r\n3", None), (4, "u", ""), (None, "n", "hello"),
        (5, "u", "x" * 3000), (6, "u", RECORD), (7, "u", "WARC/1.1\r\n"), (9, "u", RECORD * 40),
        (8, "u", "é\r\n\r\nWARC/1.1\r\n\r\nWARC/1.1\r\nz" + RECORD * 2 + "t"), (10, "u", "\r\n\r\n"),
    ]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("600", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            found = {r["page_id"]: r for r in archived(spark, rows)}
            assert len(found) == len(rows)
            for i, _, html in rows:
                data, r = (html or "").encode(), found[i]
                same = [j or -1 for j, _, h in rows if (h or "") == (html or "")]
                first = max(same)
                assert r["payload_bytes"] == len(data)
                assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
                assert (r["record_type"], r["refers_to"]) == (
                    ("response", None) if i == first else ("revisit", first))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {r["record_type"] for r in archived(spark, rows[:2], least=6)} == {"response"}
    assert archived(spark, []) == []


def test_repeated_rows_are_responses(spark):
    found = archived(spark, [(1, "a", "x"), (1, "a", "x"), (0, "b", "x")], 2)
    assert sorted((r["page_id"], r["record_type"]) for r in found) == [
        (0, "revisit"), (1, "response"), (1, "response")]


# ---- mixing


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == []


def test_targets_and_copies(spark):
    rnd = random.Random(4)
    rows = []
    for s, n in (("b", 300), ("a", 5), (None, 90), ("Z", 40), ("ö", 900), ("empty", 3)):
        for _ in range(n):
            k = 0 if s == "empty" else rnd.choice([1, 5, 30])
            rows.append((rnd.randrange(10**9), " ".join(["w"] * k) or None, s))
    rows += [rows[0]] * 3 + [(None, "x y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn(
        "size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    names = ["Z", "a", "b", "empty", "ö", None]
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    goal = brute.water_fill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, 3)
    per_size = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        per_size.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert {sizes[s]: pytest.approx(goal[s]) for s in names} == dict(per_size.keys())
    for (_, target), taken in per_size.items():
        assert math.isclose(sum(taken), target, abs_tol=2 * 30)
    again = sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)
    assert mixing.mix(df.limit(0)).count() == 0
    whole = mixing.mixture(df)
    assert whole.columns == [*df.columns, "copy"]
    assert whole.count() == sum(r["copies"] for r in got)
    clash = mixing.mixture(df.withColumn("Copy", F.lit("kept")))
    assert clash.columns == [*df.columns, "Copy", "copy_"]
    assert {r[0] for r in clash.select("Copy").distinct().collect()} == {"kept"}


# ---- vectors


@pytest.mark.parametrize("pivots,block", [(1, 1024), (512, 16), (4, 8)])
def test_vector_links(spark, monkeypatch, pivots, block):
    rnd = np.random.default_rng(5)
    rows, centres = [], rnd.normal(size=(6, 8))
    for i in range(240):
        v = centres[i % 6] + rnd.normal(size=8) * rnd.choice([0.05, 0.25, 1])
        rows.append((i, [float(x) for x in np.float32(v)], [1, 2, None][i % 7 % 3]))
    nan = float("nan")
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 8, 1), (303, [nan] + [1.0] * 7, 1),
             (304, [None] + [1.0] * 7, 1), (305, [1.0], 1), (306, [2.0], 1), (307, rows[0][1], 1),
             (308, [2 * x for x in rows[0][1]], 1), (309, [-0.0, 1.0], 2), (310, [0.0, 1.0], 2),
             (311, [1e300, 1e300], 2), (312, [float("inf"), 1.0], 2)]
    monkeypatch.setattr(embeddings, "MOST_PIVOTS", pivots)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    if pivots > 1:
        whole = embeddings._pivots
        monkeypatch.setattr(embeddings, "_pivots", lambda d, n, k, eps: {
            8: np.stack([embeddings.unit_of(np.array(r[1])) for r in rows[:pivots:2]])}
            if pivots < 99 else whole(d, n, k, eps))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    units = {}
    for i, v, label in rows:
        if v and label and all(x is not None and math.isfinite(x) for x in v) and any(v):
            units[i] = (label, len(v), embeddings.unit_of(np.array(v)))

    def linked(a, b):
        x, y = units.get(a), units.get(b)
        return bool(x and y and x[:2] == y[:2] and x[2] @ y[2] >= 0.93)

    ids = [r[0] for r in rows]
    comp = brute.components(ids, linked)
    got = {r["vec_id"]: r for r in embeddings.link(df).collect()}
    assert len(got) == len(rows)
    for i in ids:
        n = sum(linked(i, j) for j in ids if j != i)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, comp[i], comp[i] == i)


def test_pivots_that_point_the_same_way(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    ways = rnd.normal(size=(3, 8))
    copies = [w * f for w in ways for f in rnd.uniform(0.1, 9, 25)]
    others = [w + rnd.normal(size=8) * 0.05 * np.linalg.norm(w) for w in ways for _ in range(15)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*copies, *others])]
    x = np.stack([embeddings.unit_of(np.array(r[1])) for r in rows])
    pivots, eps = x[:len(copies)], math.sqrt(2 - 2 * 0.93)
    linked = x @ x.T >= 0.93
    own, near = embeddings._reach(x, pivots, eps)
    a, b = np.nonzero(linked & (own[:, None] > own))
    assert len(a) and near[a, own[b]].all()

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    chosen = embeddings._pivots
    found = {}

    def parallel(*args):
        found.update(chosen(*args))
        return {8: pivots}

    monkeypatch.setattr(embeddings, "BLOCK", 4)
    monkeypatch.setattr(embeddings, "_pivots", parallel)
    got = {r["vec_id"]: r for r in embeddings.link(df).collect()}
    same = found[8] @ found[8].T > 1 - 1e-10
    assert same.sum() == len(same)  # each with itself only
    comp = brute.components(range(len(rows)), lambda i, j: linked[i, j])
    assert all((got[i]["n_links"], got[i]["component_id"]) == (linked[i].sum() - 1, comp[i]) for i in got)


def test_vectors_of_odd_ids(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (2, [0.0, 1.0], 1)],
        "vec_id long, embedding array<float>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.link(df).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 2, 1)]
    assert embeddings.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind,labels", [
    ("string", ["a", "b", "a", None, "1"]), ("double", [1.2, 1.7, 1.2, None, 1.0]),
    ("boolean", [True, False, True, None, None]), ("tinyint", [1, 2, 1, None, 3])])
def test_labels_of_any_type(spark, kind, labels):
    rows = [(i, [1.0, 0.001 * i], label) for i, label in enumerate(labels)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link(df).collect()}
    assert got == {0: (1, 0), 1: (0, 1), 2: (1, 0), 3: (0, 3), 4: (0, 4)}
