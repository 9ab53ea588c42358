"""Exact copies, spelling variants and collocations against brute force and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from contactline.llm import copies, phrases, queries, variants

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, keep_id long, word string, state string, size int"


def docs_of(spark, texts, langs=None, ids=None):
    langs = langs or ["en"] * len(texts)
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame(
        [(i, t, lang, 9, "clash", "x", 3) for i, t, lang in zip(ids, texts, langs, strict=True)], DOCS)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ["op11_copies", "op12_spellings", "op13_collocations"])
def test_query_equals_its_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) == []


# ---- exact copies


def copies_expected(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


TEXTS = [None, "", " ", "\t\n ", "a b", "a  b", "a\x0bb", " a b", "a b", "x" * 2_000_000,
         "x" * 2_000_000 + " ", "é", "é", "same", "same", "same"]


@pytest.mark.parametrize("run", [1, 8192])
def test_copies(spark, monkeypatch, run):
    monkeypatch.setattr(copies, "RUN", run)
    rnd = random.Random(run)
    texts = TEXTS + [f"t{rnd.randrange(60)}" for _ in range(200)]
    ids = rnd.sample(range(-500, 500), len(texts))
    ids[1] = ids[2] = None
    ids[14] = ids[13]
    df = docs_of(spark, texts, ids=ids)
    found = copies.exact_copies(df.repartition(7)).collect()
    got = sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=repr)
    rows = list(zip(ids, texts, strict=True))
    assert got == copies_expected(rows)
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    whole = copies.without_copies(df)
    assert whole.columns == df.columns and whole.count() == sum(r.kept for r in found)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in found if r.kept}


def test_copies_are_verified(spark):
    """Digests that agree for different texts do not make them copies."""
    weak = lambda text: F.unhex(F.sha2(F.substring(text, 1, 1), 256))
    texts = ["ab", "ac", "ab", "ad", "b", "abc"]
    found = {r.doc_id: r for r in copies.exact_copies(docs_of(spark, texts), digest=weak).collect()}
    assert [found[i].keep_id for i in range(6)] == [0, 1, 0, 3, 4, 5]


def test_copies_of_nothing(spark):
    assert copies.exact_copies(docs_of(spark, [])).count() == 0
    assert copies.without_copies(docs_of(spark, [])).count() == 0
    assert copies.exact_copies(docs_of(spark, ["a"] * 50)).where("kept").count() == 1


def test_copies_that_share_the_smallest_id(spark, tmp_path):
    """The query against its SQL where rows come twice."""
    import duckdb

    rows = [(3, "a  b"), (1, "a b"), (1, "a\tb"), (2, "c"), (2, "c"), (4, None), (5, ""), (5, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.op11_copies(spark, str(tmp_path))
    assert differences(found, con, queries.ORACLES["op11_copies"]) == []


def test_rounds_settle_all_bits():
    for bits in range(1, 40):
        steps = copies._rounds(bits)
        assert sum(n for _, n in steps) == bits and steps[-1][0] == 0
        assert all(n <= copies.ROUND_BITS for _, n in steps)


# ---- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def variants_expected(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {}
    for w in n:
        met = [(-n[v], v) for v in n if one_edit(w, v)]
        near[w] = len(met)
        if met and -min(met)[0] >= 2 * n[w]:
            form[w] = min(met)[1]
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], near[w], form.get(w), n.get(form.get(w)), root))
    return out


@pytest.mark.parametrize("partition", [8, 20_000])
def test_variants(spark, monkeypatch, partition):
    monkeypatch.setattr(variants, "PARTITION", partition)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(4, 8))) for _ in range(150)]
    words += ["Straßen", "STRAßEN", "×××××", "ÉÉÉÉÉ", "éÉÉÉÉ", "m" * 3000, "m" * 3001, "abcde", "vwxyz"]
    texts = [None, "", "12 !", "no"]
    for _ in range(60):
        texts.append(rnd.choice([" ", "-", "1"]).join(rnd.choice(words) for _ in range(40)))
    texts += [" ".join(words)] * 3 + ["abcde " * 40]
    texts.append("zzzza " * 3 + "zzzzb " * 7 + "zzzbb " * 20)  # forms in a chain
    ids = list(range(len(texts)))
    ids[7], ids[8] = None, ids[9]
    found = variants.spelling_variants(docs_of(spark, texts, ids=ids)).collect()
    assert len({r.word for r in found}) == len(found)
    got = {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found}
    assert got == variants_expected(zip(ids, texts, strict=True))
    assert any(r.form for r in found) and any(r.root != r.form for r in found if r.form)


def test_variants_of_nothing(spark):
    for texts in ([], [None, ""], ["short few"]):
        assert variants.spelling_variants(docs_of(spark, texts)).count() == 0


def test_composition_accepts_each_pair_once():
    rnd = random.Random(4)
    for k in range(200):
        words = {"".join(rnd.choice("abc"[: 2 + k % 2]) for _ in range(rnd.randrange(1, 7)))
                 for _ in range(30)}
        m = rnd.randrange(1, 6)
        short, long = [w for w in words if len(w) == m], [w for w in words if len(w) == m + 1]
        got = Counter(frozenset(p) for p in variants.Composition(short, long).pairs())
        want = {frozenset((a, b)) for a in short for b in [*short, *long] if one_edit(a, b)}
        assert set(got) == want and set(got.values()) <= {1}


def test_acceptor_is_minimal():
    a = variants.Acceptor()
    a.add(["talks", "walks", "talked", "walked"])
    # t and w lead to one state; s and ed end in one
    assert len([x for x in a.arcs if x]) == 6


def test_long_words_take_linear_time():
    long = "a" * 60_000
    pairs = list(variants.Composition([long, long[1:] + "b"], [long + "a"]).pairs())
    assert len(pairs) == 2


# ---- collocations


def collocations_expected(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= phrases.RAREST}
        kept = []
        for p, a in found.items():
            cuts = [(1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(100 * b >= 50 * a for q, b in found.items()
                         if len(q) > len(p) and p in (q[:2], q[1:]))
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, r) in enumerate(sorted(kept)[: phrases.FIRST], 1):
            out.add((lang, rank, p.decode(), -a, left, r, n[lang], -score))
    return out


def collocated(df):
    rows = phrases.collocations(df).collect()
    assert len(rows) == len({(r.lang, r["rank"]) for r in rows})
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}


@pytest.mark.parametrize("held,first", [(3_000_000, 2000), (200, 2000), (3_000_000, 7)])
def test_collocations(spark, monkeypatch, held, first):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "RANGE", 500)
    monkeypatch.setattr(phrases, "FIRST", first)
    rnd = random.Random(held)
    words = ["new", "York", "new york", "in the", "É", "a b", "x\x1cy", "san", "of", "the", "''"]
    texts, langs = [None, "", " . ,", "a a a a a a a a a a a a a a", "\t"], ["en", "en", None, "fr", "und"]
    for k in range(150):
        parts = [rnd.choice(words) + rnd.choice([" ", "  ", "\t", ". ", "\n", " , "]) for _ in range(30)]
        texts.append("".join(parts))
        langs.append(["en", "en", "fr", None, "und", ""][k % 6])
    texts.append(" ".join(rnd.choice(words) for _ in range(3000)))  # no cut between pieces
    langs.append("en")
    assert collocated(docs_of(spark, texts, langs)) == collocations_expected(zip(langs, texts, strict=True))


def test_collocations_of_nothing(spark):
    for texts in ([], [None, ""], ["a few words"]):
        assert phrases.collocations(docs_of(spark, texts)).count() == 0


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "bitmap_of", lambda *_: np.full(1 << (phrases.MARKS - 3), 255, np.uint8))
    texts = ["one two three one two, four " * 9, "three one " * 4]
    assert collocated(docs_of(spark, texts)) == collocations_expected([("en", t) for t in texts])


def test_words_that_share_an_id_change_the_seed(spark, monkeypatch):
    real = phrases.word_id
    monkeypatch.setattr(phrases, "RANGE", 100)
    texts = ["one two three one two"] * 12
    # The first hash gives all words one id; it is shipped with the function that closes over it.
    monkeypatch.setattr(phrases, "word_id", lambda lang, w, seed: 5 if seed == 0 else real(lang, w, seed))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(phrases)
    try:
        got = collocated(docs_of(spark, texts))
    finally:
        cloudpickle.unregister_pickle_by_value(phrases)
    assert got == collocations_expected([("en", t) for t in texts])


def test_permutation_is_invertible():
    rng = np.random.default_rng(1)
    for words in (2, 3):
        ids = [rng.integers(0, 1 << 63, 1000, dtype=np.uint64) for _ in range(words)]
        ids[1][:500] = 0
        back = phrases.restored(phrases.permuted(ids))
        assert all((a == b).all() for a, b in zip(ids, back, strict=True))


@pytest.mark.parametrize("lead", [0, 1, 7, 20])
@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_filters_lose_nothing(lead, n):
    rng = np.random.default_rng(n)
    head = 1 << (lead - 1) if lead else 0
    numbers = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(3)]
    if lead:
        numbers[0] = (numbers[0] & np.uint64((1 << (64 - lead)) - 1)) | np.uint64(head << (64 - lead))
    numbers[0][: n // 2] = numbers[0][0]  # equal quotients and more
    counts = rng.choice(np.array([1, 2, 254, 255, 256, 10**12]), n)
    numbers, counts = phrases.summed(numbers, counts)
    data = phrases.encoded(numbers, counts, lead)
    again, times = phrases.decoded(data, lead, head, 3)
    assert all((a == b).all() for a, b in zip(numbers, again, strict=True)) and (times == counts).all()
