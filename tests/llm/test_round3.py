"""Whitening, one-permutation MinHash and spelling variants against plain versions."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import (
    knn_quality,
    language_id,
    one_permutation,
    order_minhash,
    packing,
    simhash,
    spelling,
    whitening,
)
from rankloom.llm.queries import QUERIES

# ---- whitening ------------------------------------------------------------------


@pytest.mark.parametrize("values", [
    np.linspace(3, 1, 24),
    np.r_[[5.0] * 4, 3 + 1e-9 * np.arange(5), np.linspace(2, 1, 9)],
    np.r_[np.ones(20), 1 + 1e-12 * np.arange(10)],
    np.r_[[1e6], np.full(6, 1e-3), [1e-3 + 1e-8]],
])
def test_eigenvectors_of_clustered_eigenvalues(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(d, d)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    scale = values.max()
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-14 * scale * d
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14 * d
    assert np.abs(a @ x - x * found).max() < 1e-14 * scale * d


def test_eigenvectors_of_nothing():
    assert whitening.eigen(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert whitening.eigen(np.zeros((0, 0)))[1].shape == (0, 0)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=10).astype("float32").tolist(), 1) for i in range(200)]
    rows += [(i + 500, rows[i][1], 1) for i in range(40)] + [rows[7], rows[7], (None, rows[3][1], 1)]
    rows += [(900, None, 1), (901, [None, *rows[0][1][1:]], 1), (902, [float("nan"), *rows[0][1][1:]], None),
             (903, [float("-inf"), *rows[0][1][1:]], 1), (904, [], 1), (905, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").repartition(4)
    return rows, df.withColumns({c: F.lit("clash") for c in ("x", "size", "component", "whitened", "v")})


def test_whitening_against_numpy(vectors):
    rows, df = vectors
    model = whitening.fit(df, components=6)
    got = whitening.whitened(df, model).collect()
    good = [r for r in rows if r[1] is not None and len(r[1]) == 10 and all(c is not None and np.isfinite(c) for c in r[1])]
    x = np.floor(64 * np.array([r[1] for r in good], dtype=float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 6 * len(good) and {r.n for r in got} == {n}
    want = defaultdict(list)
    for r, p, d in zip(good, (x - s / n) @ axes[:, :6] / np.sqrt(values[:6]), ((n * x - s) ** 2).sum(axis=1), strict=True):
        want[r[0]] += [(k + 1, abs(v), int(d)) for k, v in enumerate(p)]
    have = defaultdict(list)
    for r in got:
        have[r.vec_id].append((r.component, abs(r.whitened), r.deviation))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
    for key, rows_of in want.items():
        a, b = np.array(sorted(rows_of)), np.array(sorted(have[key]))
        assert np.abs(a - b).max() < 1e-8


def test_whitening_of_little(spark, vectors):
    _, df = vectors
    none = df.where("false")
    assert whitening.whitened(none, whitening.fit(none)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(one, whitening.fit(one)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whitened(line, whitening.fit(line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9  # the other directions have no variance


def test_whitening_of_far_vectors(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened(df, whitening.fit(df)).collect()
    assert got and {r.deviation for r in got} == {None}


def test_deviation_is_exact(spark):
    rows = [(i, [float(2**20 * (i % 3)), float(i)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whitened(df, whitening.fit(df)).collect()}
    x = [[64 * 2**20 * (i % 3) + 1_000_000, 64 * i + 1_000_000] for i in range(50)]
    s = [sum(c) for c in zip(*x)]
    for i, row in enumerate(x):
        exact = sum((50 * a - b) ** 2 for a, b in zip(row, s))
        assert got[i] == (exact if exact < 2**63 else None)


# ---- one-permutation MinHash -------------------------------------------------------


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return set(zip(*(w[i:] for i in range(4)))) if len(w) >= 4 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [a + b for a in "bcdfgklm" for b in ("a", "e", "o", "ü")]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    out, doc = [], 0
    for family in range(12):
        base = text(rng.randint(4, 160))
        for _ in range(rng.randint(1, 14)):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(words)
            out.append((doc, " ".join(near)))
            doc += 3
    chain = text(60)  # each like the next, the ends unlike
    for step in range(12):
        chain = [*chain[2:], *text(2)]
        out.append((doc, " ".join(chain)))
        doc += 1
    out += [(doc + 1, None), (doc + 2, ""), (doc + 3, " \t\n"), (doc + 4, "a b"), (doc + 5, "A  B"), (doc + 6, "a b c"), (doc + 7, out[0][1].upper())]
    out += [(doc + 8, " ".join(text(30_000))), out[4], out[4], (None, out[4][1]), (None, "only without id here"), (None, None)]
    return out


def test_components_against_all_pairs(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    df = df.withColumns({c: F.lit("clash") for c in ("label", "n", "root", "key", "text_hash", "c1", "component_id")})
    got = one_permutation.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(plain_components(texts))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert one_permutation.near_duplicates(df.where("false")).collect() == []


def test_agreement_of_bins_is_the_likeness():
    """Also of few shingles, where most bins are drawn from others."""
    rng = random.Random(4)
    for size, shared in ((12, 9), (60, 50), (2000, 1700)):
        agree = []
        for _ in range(20):
            common = [rng.getrandbits(64) for _ in range(shared)]
            sets = [np.array(sorted(common + [rng.getrandbits(64) for _ in range(size - shared)]), dtype=np.uint64) for _ in "ab"]
            a, b = (one_permutation.signatures(s, np.array([0, len(s)]))[0] for s in sets)
            assert one_permutation.EMPTY not in a
            agree.append((a == b).mean())
        assert np.mean(agree) == pytest.approx(shared / (2 * size - shared), abs=0.06)


def test_sets_of_a_batch():
    h, edges = one_permutation.shingle_sets(pa.array(["a b c d e", None, "x", "a b c d a b c d", "A b"]))
    assert np.diff(edges).tolist() == [2, 0, 1, 4, 1]
    assert all(np.all(np.diff(h[a:b].astype(object)) > 0) for a, b in itertools.pairwise(edges))
    none = one_permutation.shingle_sets(pa.array([], pa.string()))
    assert len(none[0]) == 0 and one_permutation.signatures(*none).shape == (0, one_permutation.BINS)


def test_a_large_family_is_not_paired(spark):
    """Every star has one centre: the pairs of a group grow with its members."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(150):
        near = list(base)
        near[i] = "other"
        rows.append((i, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = one_permutation.near_duplicates(df).collect()
    assert {r.component_id for r in got} == {0}
    buckets = spark.createDataFrame(
        [(k, i, 9, 150, i if k else 7) for k in range(3) for i in range(50)], "key long, label long, n long, degree long, root long"
    )
    assert sorted((r.key, r.centre) for r in one_permutation.stars(buckets).collect()) == [(1, 49), (2, 49)]


# ---- spelling ------------------------------------------------------------------------


def plain_words(rows):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    total = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(13)
    letters = "abcdeéüÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 14))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    rows = []
    for i in range(120):
        some = []
        for _ in range(60):
            w = base[min(len(base) - 1, int(rng.expovariate(0.2)))]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            some.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "Ā"]).join(some)))
    # Forms of forms: each ten times as frequent as the one before.
    for w, n in (("steppers", 2), ("stepperz", 20), ("steppezz", 200)):
        rows.append((5000 + n, " ".join([w] * n)))
    return rows + [(7000, None), (7001, ""), (7002, "123 !"), rows[0], rows[0], (None, rows[1][1]), (7003, "q" * 50_000 + " " + "q" * 50_000)]


def test_variants_against_all_pairs(spark, misspelt):
    df = spark.createDataFrame(misspelt, "doc_id long, text string").repartition(4)
    df = df.withColumns({c: F.lit("clash") for c in ("word", "n", "form", "root", "sig")})
    got = [tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_variants(misspelt)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(f is not None and r != f for _, f, r, *_ in want)  # a form of a form
    assert spelling.variants(df.where("false")).collect() == []


def test_signatures_meet_in_every_edit():
    """Of any word and any one edit, whatever the parts."""
    rng = random.Random(14)
    for _ in range(300):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 12)))
        at = rng.randrange(len(word) + 1)
        other = rng.choice([word[:at] + rng.choice("abcz") + word[at:], word[:at] + "z" + word[at + 1 :], word[:at] + word[at + 1 :]])
        part = {(c, i): rng.randrange(4) for c in "abcézq" for i in range(3)}
        a, b = spelling.signatures([word, other], part, 4)
        assert word == other or set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize("name", ["op11_whitening", "op12_minhash", "op13_spelling"])
def test_queries_give_their_columns(spark, small, name):
    columns = {
        "op11_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        "op12_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
        "op13_spelling": ["word", "form", "root", "n", "n_near", "form_n"],
    }
    df = QUERIES[name](spark, small)
    assert df.columns == columns[name] and df.count() > 0


# ---- earlier operators ---------------------------------------------------------------


def test_short_texts_in_another_order(spark):
    rng = random.Random(20)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(12):
        w = [rng.choice(words) for _ in range(24)]
        rows.append((" ".join(w), " ".join(w[18:] + w[12:18] + w[6:12] + w[:6])))
    df = spark.createDataFrame(rows, "a string, b string")
    s = order_minhash.sketch
    likes = [r[0] for r in df.select(order_minhash.likeness(s(F.col("a")), s(F.col("b")))).collect()]
    assert np.mean(likes) < 0.1 and all(
        r[0] == 1.0 for r in df.select(order_minhash.likeness(s(F.col("a")), s(F.col("a")))).collect()
    )


def test_one_character_in_a_long_run(spark):
    rng = random.Random(21)
    run = "".join(rng.choice("abcdefghijklmnop") for _ in range(600))
    df = spark.createDataFrame([(run, "x" + run), (run, run[:300] + "y" + run[300:])], "a string, b string")
    s = order_minhash.sketch
    likes = [r[0] for r in df.select(order_minhash.likeness(s(F.col("a")), s(F.col("b")))).collect()]
    assert min(likes) > 0.8


def test_equal_rows_are_one_document(spark):
    rows = [(1, "a b c d"), (2, "e f g"), (2, "e f g"), (3, "h i"), (3, "h i"), (3, "h i"), (None, "j"), (None, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str(r.doc_id) for r in order_minhash.edited_pairs(df).collect()) == ["1", "2", "3", "None"]


def test_languages_of_long_runs(spark):
    rng = random.Random(22)
    run = lambda letters: "".join(rng.choice(letters) for _ in range(90))
    rows = [(i, "the cat sat on the mat", "en") for i in range(8)] + [(50 + i, " ".join(run("xyzw") for _ in range(4)), "zz") for i in range(8)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, run("xyzw")), (2, "the mat")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predicted(asked, model).collect()} == {1: "zz", 2: "en"}
    word = "".join(rng.choice("abc") for _ in range(1000))
    pieces = language_id.pieces(word)
    held = {p[i : i + 4] for p in pieces for i in range(len(p) - 3)}
    assert held == {word[i : i + 4] for i in range(997)} and max(map(len, pieces)) == 64


def test_an_id_in_many_rows_is_one_neighbour(spark):
    rows = [(i, f"good text number {i} with words") for i in range(6)] + [(i, f"{i} !!! ### {i}") for i in range(6, 12)]
    docs = spark.createDataFrame(rows + [rows[0]] * 200 + [(0, "another text of the id")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(12)], "doc_id long, quality int")
    model = knn_quality.fit(docs, labels, neighbours=3)
    assert len(model.vectors) == 12
    scores = {(r.doc_id, round(r.score, 12)) for r in knn_quality.score(docs, model).collect()}
    assert len([k for k, _ in scores if k == 0]) <= 2  # repeated rows agree
    assert knn_quality.score(docs.where("false"), model).count() == 0
    none = knn_quality.fit(docs, labels.where("false"))
    assert {r.score for r in knn_quality.score(docs, none).collect()} == {0.5}


def test_shapes_differ_beyond_any_prefix():
    a, b = (knn_quality.terms(b"a-" * 40 + end) for end in (b"1", b"!"))
    assert a != b


def test_ties_with_the_last_neighbour_vote(spark):
    """The same whatever the order of the labelled rows."""
    rows = [([i % 3], [1.0]) for i in range(12)]
    y = np.array([i % 2 for i in range(12)], dtype=float)
    scores = []
    for order in (range(12), reversed(range(12))):
        at = list(order)
        model = knn_quality.fit_rows([rows[i] for i in at], y[at], (6, 6), 8, 4, 3)
        scores.append(model.scores([b"x", b"y z"]).tolist())
    assert scores[0] == pytest.approx(scores[1])


def test_word_cache_of_two_generations(monkeypatch):
    """Small caches change nothing."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    rng = random.Random(23)
    odd = ["Größe", "don't", "x" * 100, "naïve!!", "100,5", "(ab)", "Ω", "été,", ""]
    batches = [
        pa.array([" ".join(rng.choice(odd) if rng.random() < 0.2 else f"w{rng.randrange(300)}" for _ in range(50)) for _ in range(4)] + [None])
        for _ in range(12)
    ]
    large = packing.WordCoder(vocabulary)
    want = [[ids.tolist() for ids in large.encode(b)] for b in batches]
    monkeypatch.setattr(packing, "CACHED", 60)
    small = packing.WordCoder(vocabulary)
    assert [[ids.tolist() for ids in small.encode(b)] for b in batches] == want
    plain = large.tokenizer.encode(batches[0][0].as_py(), add_special_tokens=False).ids
    assert want[0][0] == plain


def test_long_and_short_lists_agree(spark):
    rng = random.Random(24)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 3))) for base in (5, 1 << 40) for _ in range(80)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    found = []
    for longest in (0, 5, 64, 10_000):
        links = simhash.links(df, 2, longest)
        roots = simhash.components(df.withColumn("label", F.col("fingerprint")), links).collect()
        found.append(sorted((r.fingerprint, r.root) for r in roots))
    assert all(f == found[0] for f in found)
