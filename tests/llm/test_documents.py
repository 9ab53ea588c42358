"""Near duplicates, repeated passages, leaks, quality and the pipeline against brute force."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from contactline.llm import decontaminate, minhash, quality, suffixes
from contactline.llm.common import numbered

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int"


def docs_of(spark, texts, first=0):
    rows = [(i + first, t, "en", "s", None if t is None else len(t), "clash", 3)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(rnd, n):
    return " ".join(rnd.choice(["ab", "cde", "f", "ghij", "kl", "mnö", "op"]) + str(rnd.randrange(40))
                    for _ in range(n))


# ---- near duplicates


def near_expected(texts, size):
    texts = texts if isinstance(texts, dict) else dict(enumerate(texts))
    sets = {i: brute.shingles(t, size) for i, t in texts.items()}

    def linked(a, b):
        x, y = sets[a], sets[b]
        common = len(x & y)
        return bool(x and y) and 100 * common >= 80 * (len(x) + len(y) - common)

    return sets, brute.components(list(sets), linked)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rnd = random.Random(size)
    texts = [None, "", " \t\n", "one", "ONE", "one two", "Two one", "a a", "A a a a", "a b c d e", "a b c d e a b c d e", "x" * 5000, "é é", "é é"]
    for _ in range(6):  # chains of texts that drift apart
        w = sentence(rnd, 60).split()
        for _ in range(6):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(9)}"
    texts += [texts[14], texts[15].upper()] + [sentence(rnd, 80) for _ in range(20)]
    sets, comp = near_expected(texts, size)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(spark, texts), size).collect()}
    assert len(found) == len(texts)
    for i in sets:
        r = found[i]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (
            len(sets[i]), comp[i], comp[i] == i), texts[i]
    assert len(set(comp.values())) < len(texts) - 10


def test_blocks_join_what_pivots_leave(spark, monkeypatch):
    rnd = random.Random(5)
    base = sentence(rnd, 80).split()
    texts = []
    for _ in range(40):  # all alike, but only some pairs similar enough
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(999)}"
        texts.append(" ".join(w))
    _, comp = near_expected(texts, 2)
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 600)
    found = minhash.near_duplicates(docs_of(spark, texts), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == comp


def test_near_duplicates_of_odd_ids(spark):
    text = "a b c d e f g h i j"
    rows = [(None, text), (3, text), (3, text), (5, "z y x w"), (None, "q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(minhash.near_duplicates(df).collect(), key=str)
    assert len(found) == 5
    assert sum(r["kept"] for r in found if r["doc_id"] is not None) == 3
    assert [r["component_id"] for r in found if r["doc_id"] is None and r["n_shingles"] > 4] == [3]
    assert minhash.one_of_each(df).count() == 3
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.one_of_each(docs_of(spark, [])).columns == docs_of(spark, []).columns


def test_estimate_corrects_for_chance(spark):
    rnd = random.Random(1)
    a = [f"w{rnd.randrange(10**6)}" for _ in range(2000)]
    b = a[:1500] + [f"v{i}" for i in range(500)]
    df = docs_of(spark, [" ".join(a), " ".join(b)])
    rows, _ = numbered(df, "doc_id", "text")
    s = minhash.sketches(rows, 2).select("row", "signature")
    x, y = s.where("row = 0"), s.where("row = 1").select(F.col("signature").alias("other"))
    got = x.crossJoin(y).select(minhash.estimate(F.col("signature"), F.col("other"))).first()[0]
    assert abs(got - 0.6) < 0.15


# ---- repeated passages


def passages(rnd):
    block = [sentence(rnd, 30) for _ in range(4)]  # above 100 bytes each
    texts = [None, "", "short", "ü" * 120, "ü" * 130, "ab" * 400]
    for _ in range(25):
        parts = [sentence(rnd, rnd.randrange(20)) for _ in range(3)]
        parts.insert(rnd.randrange(3), rnd.choice(block)[rnd.randrange(30):])
        texts.append(" ".join(parts))
    return [*texts, texts[8], texts[9] + "tail"]


def test_repeats(spark):
    texts = passages(random.Random(2))
    data = [(t or "").encode() for t in texts]
    want = [brute.repeat_row(t, g) for t, g in zip(data, brute.repeats(data), strict=True)]
    found = {r["doc_id"]: r for r in suffixes.remove(docs_of(spark, texts)).collect()}
    for i, w in enumerate(want):
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == w, i
    assert sum(w[1] for w in want) > 1000


def test_repeats_of_hot_anchors(spark, monkeypatch):
    texts = passages(random.Random(3))
    data = [(t or "").encode() for t in texts]
    want = [brute.repeat_row(t, g)[1] for t, g in zip(data, brute.repeats(data), strict=True)]
    everything = suffixes.np.unique(suffixes.segments(data)[0])
    monkeypatch.setattr(suffixes, "_load", lambda rows: (10, everything))
    found = {r["doc_id"]: r["n_removed"] for r in suffixes.remove(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_load_finds_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SAMPLED", 1)
    monkeypatch.setattr(suffixes, "ANCHORS", 40)
    rows, _ = numbered(docs_of(spark, ["x" * 5000, *[sentence(random.Random(i), 60) for i in range(9)]]),
                       "doc_id", "text")
    total, hot = suffixes._load(rows)
    assert total > 80 and len(hot) == 1


def phrases(rnd, n):
    """A phrase many times in one text, with changing surroundings."""
    phrase = "".join(rnd.choice("abcdefghijk") for _ in range(110))
    return " ".join(f"{rnd.randrange(10**9)} {phrase}" for _ in range(n))


def test_large_anchors_of_one_text(spark, monkeypatch):
    texts = [*passages(random.Random(5))[:6], phrases(random.Random(5), 60), phrases(random.Random(6), 9)]
    texts.append(texts[-2][2000:4000])
    data = [(t or "").encode() for t in texts]
    want = [brute.repeat_row(t, g)[1] for t, g in zip(data, brute.repeats(data), strict=True)]
    monkeypatch.setattr(suffixes, "ANCHORS", 80)
    nothing = suffixes.np.zeros(0, suffixes.np.uint64)
    monkeypatch.setattr(suffixes, "_load", lambda rows: (10, nothing))  # the sample missed them
    made, settled_otherwise = suffixes.materialise, suffixes._hot_repeats
    cut, hot = [], []

    def keeping(df, name):
        out = made(df, name)
        cut.extend([out] if name == "segments" else [])
        return out

    monkeypatch.setattr(suffixes, "materialise", keeping)
    monkeypatch.setattr(suffixes, "_hot_repeats", lambda df: hot.append(df) or settled_otherwise(df))
    found = {r["doc_id"]: r["n_removed"] for r in suffixes.remove(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == want and want[-1] and want[-3]
    sizes = cut[0].groupBy("kind", "anchor").count().collect()
    assert len(hot) == 1 and {r["kind"] for r in sizes} == {1, 2}
    assert all((r["count"] > 20) == (r["kind"] == 2) for r in sizes)


def test_load_finds_hot_anchors_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "ANCHORS", 4000)
    rows, _ = numbered(docs_of(spark, [phrases(random.Random(7), 9000), "short"], first=1), "doc_id", "text")
    total, hot = suffixes._load(rows)
    assert len(hot) and 9000 < total < 90000


def test_two_stage_sorting_orders_suffixes():
    rnd = random.Random(4)
    for alphabet in (b"a", b"ab", b"\x00\xff\x80", bytes(range(256))):
        for n in (0, 1, 2, 50, 400):
            t = bytes(rnd.choice(alphabet) for _ in range(n))
            order = suffixes.suffix_array(suffixes.np.frombuffer(t, suffixes.np.uint8))
            assert sorted(order.tolist()) == list(range(n))
            keys = [t[i:].ljust(0)[: suffixes.LENGTH] for i in order]
            assert all(a <= b or a.rstrip(b"\x00") <= b.rstrip(b"\x00") for a, b in zip(keys, keys[1:]))
            got = suffixes.common_prefixes(suffixes.np.frombuffer(t, suffixes.np.uint8), order)
            for a, b, k in zip(order, order[1:], got, strict=False):
                x, y = t[a:a + 100], t[b:b + 100]
                same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
                assert k == same or (k > same >= min(len(x), len(y)))


def test_cut_texts_keep_whole_characters(spark):
    text = "é" * 100
    df = docs_of(spark, [text + "x", "y" + text, None, ""])
    got = {r["doc_id"]: r for r in suffixes.without_repeats(df).collect()}
    # The strings of 100 bytes repeat inside the first text already.
    assert got[2]["text"] is None and got[3]["text"] == "" and got[2]["n_chars"] is None
    assert set(got[0]["text"]) <= {"é", "x"} and got[1]["text"][0] == "y"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)
    assert suffixes.without_repeats(df).columns == df.columns


def test_repeats_of_odd_ids(spark):
    text = sentence(random.Random(9), 60)
    df = spark.createDataFrame([(7, text), (7, text), (None, text)], "doc_id long, text string")
    got = sorted(r["n_removed"] for r in suffixes.remove(df).collect())
    assert got == [0, len(text.encode()), len(text.encode())]
    assert suffixes.remove(df.limit(0)).count() == 0
    assert sorted(len(r["text"]) for r in suffixes.without_repeats(df).collect()) == [0, 0, len(text)]


# ---- decontamination


def test_tiles_are_those_of_the_definition():
    rnd = random.Random(6)
    for _ in range(150):
        p = [rnd.randrange(1, 5) for _ in range(rnd.randrange(40))]
        t = [rnd.randrange(5) for _ in range(rnd.randrange(60))]
        if rnd.random() < 0.7 and p:
            k = rnd.randrange(len(p))
            t = t[:9] + p[k:] + [0] + p[:k] + t[9:]
        for shortest in (3, 5):
            got = decontaminate.tiles(p, t, shortest)
            want = brute.greedy_tiles(p, t, shortest)
            assert sum(x[2] for x in got) == sum(x[2] for x in want)
            assert sorted(x[2] for x in got) == sorted(x[2] for x in want)


def test_reordered_passages_are_found(spark):
    rnd = random.Random(8)
    item = [f"w{i}" for i in range(40)]
    noise = lambda n: [f"n{rnd.randrange(10**6)}" for _ in range(n)]
    texts = [
        " ".join(noise(50) + item + noise(50)),
        " ".join(noise(9) + item[20:] + noise(3) + item[:20]),
        " ".join(w.upper() + "!," for w in item),
        " ".join(noise(5) + item[:20] + noise(5)),
        " ".join(noise(200)), None, "", " ".join(item[:4]),
        " ".join(x for w in item for x in (w, "no")),
    ]
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (2, "too short here"), (3, None), (1, " ".join(item))],
        "item_id long, text string")
    found = decontaminate.contaminated(docs_of(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["covered_words"]) for r in found} == {
        (0, 1, 40), (1, 1, 40), (2, 1, 40)}
    assert all(r["coverage"] == 1.0 for r in found)
    kept = decontaminate.without_contaminated(docs_of(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7, 8]
    assert kept.columns == docs_of(spark, texts).columns
    assert decontaminate.contaminated(docs_of(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_whoever_covers_an_item_has_a_needed_seed():
    rnd = random.Random(12)
    for _ in range(400):
        n = rnd.randrange(5, 40)
        held = np.array([rnd.randrange(30) for _ in range(n - 4)])
        frequent = [rnd.randrange(1, 5) for _ in range(30)]
        places, counts = np.arange(n - 4), np.array([frequent[s] for s in held])
        rare = set(decontaminate.needed(places, held, counts, n, 0.6).tolist())
        for _ in range(20):
            shared = {s for s in held.tolist() if rnd.random() < rnd.random()}
            under = {w for p, s in enumerate(held) if s in shared for w in range(p, p + 5)}
            assert len(under) < 0.6 * n or shared & rare


def test_leaks_are_those_of_all_pairs(spark):
    """Few words, so that most texts share seeds: what the rarest seeds leave out has no leak."""
    rnd = random.Random(13)
    words = lambda n: [rnd.choice("abc") for _ in range(n)]
    items = [words(rnd.randrange(4, 30)) for _ in range(12)]
    texts = [words(rnd.randrange(60)) for _ in range(40)]
    for t in texts[::4]:
        t[5:5] = rnd.choice(items)[rnd.randrange(6):]
    bench = spark.createDataFrame(
        [(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(docs_of(spark, [" ".join(t) for t in texts]), bench).collect()
    want = set()
    number = {"a": 1, "b": 2, "c": 3}
    for d, t in enumerate(texts):
        for i, w in enumerate(items):
            laid = decontaminate.tiles([number[x] for x in w], [number[x] for x in t])
            if laid and sum(x[2] for x in laid) >= 0.6 * len(w):
                want.add((d, i, sum(x[2] for x in laid)))
    got = {(r["doc_id"], r["item_id"], r["covered_words"]) for r in found}
    assert got == want and want


def test_a_common_phrase_brings_no_pairs(spark, monkeypatch):
    """In all documents and items, but too short for a leak: few documents meet an item."""
    rnd = random.Random(14)
    noise = lambda n: " ".join(f"n{rnd.randrange(10**6)}" for _ in range(n))
    phrase = "this phrase is in all of the texts"
    texts = [f"{noise(20)} {phrase} {noise(20)}" for _ in range(400)]
    bench = [(i, f"{noise(10)} {phrase} {noise(10)}") for i in range(50)]
    texts[7] = bench[3][1]
    met = []
    tiled = decontaminate._tiled
    monkeypatch.setattr(
        decontaminate, "_tiled", lambda pairs, least: met.append(pairs.count()) or tiled(pairs, least))
    found = decontaminate.contaminated(
        docs_of(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(7, 3)]
    assert met == [1]


# ---- quality


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(None, None, "x", None, None), (-1, "", None, "s", 0)], docs.schema)
    rows = quality.classify(docs.union(odd), labels).collect()
    assert len(rows) == docs.count() + 2
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"]
               for r in rows if r["doc_id"] is not None)
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    for sign in (docs.limit(0), docs):
        flat = quality.classify(sign, labels.limit(0)).select("score").distinct().collect()
        assert [r[0] for r in flat] in ([], [0.5])


def test_compiled_rules_score_as_written(spark):
    rules = (((0, "<=", 2.0), (1, ">", 1.0)), ((1, ">", 5.0),))
    ensemble = quality.Ensemble(0.5, ((rules[0], -1.0), (rules[1], 2.0)))
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 6.0],), ([9.0, 6.0],)], "stats array<double>")
    got = [r[0] for r in df.select(ensemble.score(F.col("stats"))).collect()]
    want = [1 / (1 + 2.718281828459045 ** -z) for z in (-0.5, 1.5, 2.5)]
    assert got == pytest.approx(want)
    text = "Tree 0\n  If (feature 0 <= 2.0)\n   If (feature 1 > 1.0)\n    Predict: 0.0\n   Else (feature 1 <= 1.0)\n    Predict: 1.0\n  Else (feature 0 > 2.0)\n   Predict: 1.0\n"
    assert set(quality.paths(text)) == {
        ((0, "<=", 2.0),), rules[0], ((0, "<=", 2.0), (1, "<=", 1.0)), ((0, ">", 2.0),)}


def test_paths_are_those_of_the_trees(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rnd = random.Random(21)
    rows = [([rnd.random(), rnd.randrange(5) / 3, rnd.gauss(0, 1)], float(rnd.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "stats array<double>, label double").select(
        array_to_vector("stats").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=3, maxDepth=4, seed=3).fit(df)
    found = set()

    def walk(node, conditions):
        if conditions:
            found.add(tuple(sorted(conditions)))
        if node.getClass().getSimpleName() == "InternalNode":
            i, v = node.split().featureIndex(), node.split().threshold()
            walk(node.leftChild(), conditions | {(i, "<=", v)})
            walk(node.rightChild(), conditions | {(i, ">", v)})

    for tree in forest._java_obj.trees():
        walk(tree.rootNode(), frozenset())
    assert set(quality.paths(forest.toDebugString)) == found and len(found) > 20


@pytest.fixture
def ensembles(monkeypatch):
    """Ensembles that are fitted in a test."""
    fitted, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    return fitted


def test_scores_are_those_of_the_definition(spark, ensembles):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    more = spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "A a\nA! 1|2 $é\r\n"), (-5, "x" * 200_000)], docs.schema)
    docs = docs.union(more)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.statistics(docs, "doc_id").collect():
        assert r["stats"] == pytest.approx(brute.statistics(texts[r["doc_id"]]))
    rows = quality.classify(docs, labels).collect()
    ensemble, = ensembles
    assert ensemble.rules and len(rows) == len(texts)
    for r in rows:
        want = brute.rule_score(ensemble.intercept, ensemble.rules, brute.statistics(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(want)
    kept = quality.accepted(docs, labels).select("doc_id").collect()
    assert {r[0] for r in kept} == {r["doc_id"] for r in rows if r["predicted"]}
    assert ensembles[0] == ensembles[1]


# ---- pipeline


def test_pipeline_against_brute_force(spark, ensembles):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    given = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ensemble, = ensembles
    ids = sorted(i for i, r in given.items() if brute.rule_score(
        ensemble.intercept, ensemble.rules, brute.statistics(r["text"])) >= 0.3)
    good = len(ids)
    _, component = near_expected({i: given[i]["text"] for i in ids}, 5)
    ids = [i for i in ids if component[i] == i]
    single = len(ids)
    gone = brute.repeats([(given[i]["text"] or "").encode() for i in ids])
    texts = {i: brute.cut_whole(given[i]["text"] or "", g) for i, g in zip(ids, gone, strict=True)}
    cut = sum(texts[i] != (given[i]["text"] or "") for i in ids)
    clean = [i for i in ids if not any(brute.leaked(texts[i], x) for x in items)]
    copies = brute.copies([(i, len(brute.words(texts[i])), given[i]["source"]) for i in clean])
    want = Counter({(i, texts[i], given[i]["source"]): n for i, n in copies.items() if n})
    assert Counter((r["doc_id"], r["text"] or "", r["source"]) for r in got) == want
    # every stage has had something to do
    assert len(given) > good > single > len(clean) and cut and set(copies.values()) != {1}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.limit(1).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang",
        F.lit(None).cast("string").alias("source"), "n_chars")
    given = docs.union(first).union(docs.limit(2)).withColumn("row", F.lit("x"))
    at = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF)
        assert after.columns == given.columns, name
        assert after.count() <= at.count()
        at = spark.createDataFrame(after.collect(), after.schema)
        assert stage(spark, given.limit(0), SF).count() == 0
    ids = [r["doc_id"] for r in at.collect()]
    assert len(ids) == len(set(ids)) and len(ids) > 100
    mixed = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert mixed.columns[:-1] == given.columns
    assert set(mixed.select("doc_id").toPandas()["doc_id"].dropna()) <= set(ids)
