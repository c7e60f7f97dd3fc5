"""Skills, spans, term weights, perplexity and vectors against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import cleaning, vectors
from rankloom.operators import matching, ml, skills, spans, text_stats
from rankloom.plans.entities import Entities


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("I know Python.", ["i", "know", "python", "."]),
        ("node.js, .net and pci-dss!", ["node.js", ",", ".net", "and", "pci", "-", "dss", "!"]),
        ("(ci/cd) c# c++ att&ck", ["(", "ci", "/", "cd", ")", "c", "#", "c++", "att&ck"]),
        ("a,b 1,2 x:y 3:4 -x-", ["a", ",", "b", "1,2", "x", ":", "y", "3:4", "-x-"]),
        ("'((don't)).,", ["'", "(", "(", "do", "n't", ")", ")", ".", ","]),
        ("...", [".", ".", "."]),
        ("x..." + "." * 20000, ["x"] + ["."] * 20003),
        ("a!b .a. (.b)", ["a!b", ".a", ".", "(", ".b", ")"]),
    ],
)
def test_tokens(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(skills.tokenise(F.col("t"))).first()[0] == tokens


def test_skills(spark):
    phrases = skills.gazetteer(
        spark.createDataFrame([(p,) for p in ("sql", "SQL server", "node.js", "pci-dss", ".net", "c#", "go", "go")], "phrase string")
    )
    docs = spark.createDataFrame(
        [(1, "SQL Server, sql. server node.js!"), (2, "PCI-DSS and .NET; go go"), (3, "nothing"), (4, None), (5, "")],
        "doc_id int, text string",
    )
    hits = {(r.doc_id, r.skill): r.hits for r in skills.skill_match(docs, phrases).collect()}
    assert hits == {
        (1, "sql"): 2, (1, "sql server"): 1, (1, "node.js"): 1, (2, "pci-dss"): 1, (2, ".net"): 1, (2, "go"): 2,
    }
    pool = {r.doc_id: r.skills for r in skills.skill_pool(docs, phrases).collect()}
    assert pool == {1: ["node.js", "sql", "sql server"], 2: [".net", "go", "pci-dss"], 3: [], 5: []}


def test_overlap(spark):
    row = spark.sql("SELECT array('b', 'a') has, array('c', 'b', 'd') wants, array() none").select(
        skills.skill_overlap(F.col("has"), F.col("wants")),
        skills.missing_skills(F.col("has"), F.col("wants")),
        skills.overlap_ratio(F.col("has"), F.col("wants")),
        skills.overlap_ratio(F.col("has"), F.col("none").cast("array<string>")),
    ).first()
    assert (row[0], row[1], row[2], row[3]) == (["b"], ["c", "d"], pytest.approx(1 / 3), None)


SPAN_CASES = [
    ("a python b", ["2", "8", "L"], (2, 8, False, None)),
    ("python", ["0", "99", "L"], (0, 6, True, None)),
    ("python", ["-3", "6", "L"], (0, 6, True, None)),
    ("a python b", ["5", "3", "L"], (3, 5, True, None)),
    ("a  b", ["1", "2", "L"], (0, 3, True, None)),
    ("      ", ["1", "2", "L"], (None, None, False, "empty-or-whitespace")),
    ("      ", ["4", "2", "L"], (None, None, False, "out-of-bounds")),
    ("", ["0", "3", "L"], (None, None, False, "out-of-bounds")),
    ("abc", ["x", "3", "L"], (None, None, False, "bad-format")),
    ("abc", ["1", "3"], (None, None, False, "bad-format")),
    ("a😀b", ["1", "2", "L"], (1, 2, False, None)),
    ("word" + " " * 60, ["40", "41", "L"], (0, 64, True, None)),
    ("é\r\nx", ["0", "9", "L"], (0, 3, True, None)),
]


@pytest.fixture(scope="module")
def repaired(spark):
    rows = [(f"{i:02d}.json", t, None, [s]) for i, (t, s, _) in enumerate(SPAN_CASES)]
    rows.append(("99.json", None, None, None))
    df = spark.createDataFrame(rows, "file string, text string, spans array<array<string>>, annotations array<array<string>>")
    return spans.span_repair(df).cache()


def test_span_repair(repaired):
    out = {r.file: r.repaired for r in repaired.collect()}
    for i, (text, raw, expected) in enumerate(SPAN_CASES):
        s = out[f"{i:02d}.json"][0]
        assert (s.start, s.end, s.fixed, s.reason) == expected, (text, raw)
    assert out["99.json"] == []


def test_span_products(repaired):
    stats = spans.span_stats(repaired).first()
    bad = sum(c[2][3] is not None for c in SPAN_CASES)
    fixed = sum(c[2][2] for c in SPAN_CASES)
    assert tuple(stats) == (len(SPAN_CASES) + 1, len(SPAN_CASES), fixed, bad)
    examples = {r.file: r.spans for r in spans.span_examples(repaired).collect()}
    assert len(examples) == len(SPAN_CASES) + 1 and examples["05.json"] == [] and len(examples["00.json"]) == 1
    assert [r.file for r in spans.rejected_sample(repaired, 2).collect()] == ["05.json", "06.json"]


def test_label_inventory(spark):
    rows = [("a", "SKILL: go"), ("a", "SKILL: go"), ("b", "SKILL: go"), ("b", "OTHER")]
    inventory = skills.label_inventory(spark.createDataFrame(rows, "file string, label string"))
    assert {r.label: (r.spans, r.files) for r in inventory.collect()} == {"SKILL: go": (3, 2), "OTHER": (1, 1)}
    assert [r.skill for r in skills.mined_gazetteer(inventory).collect()] == ["go"]


TEXTS = {1: "the cat sat on the mat", 2: "The dog; the cat!", 3: "", 4: "x y z", 5: "one", 6: "mat mat mat mat"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id int, text string")


def words_of(text):
    return re.findall(r"\w\w+", text.lower())


def test_tfidf(docs):
    counts = {d: Counter(words_of(t)) for d, t in TEXTS.items()}
    df = Counter(w for c in counts.values() for w in c)
    expected = {}
    for d, c in counts.items():
        raw = {w: n * (math.log((1 + len(TEXTS)) / (1 + df[w])) + 1) for w, n in c.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        expected |= {(d, w): x / length for w, x in raw.items()}
    got = {(r.doc_id, r.term): r.weight for r in text_stats.tfidf(docs).collect()}
    assert got == {k: pytest.approx(v) for k, v in expected.items()}
    flags = {r.doc_id: r.is_suspicious for r in text_stats.stuffing_flag(docs, text_stats.tfidf(docs)).collect()}
    assert flags == {d: sum(v > 0.1 for (e, _), v in expected.items() if e == d) > 1 for d in TEXTS}


def test_tfidf_of_another_corpus(spark, docs):
    corpus = spark.createDataFrame([(1, "cat cat dog"), (2, "cat")], "doc_id int, text string")
    got = text_stats.tfidf(docs, model=text_stats.TermModel.fit(corpus))
    assert {r.term for r in got.select("term").collect()} == {"cat", "dog"}


@pytest.mark.parametrize("limit", [None, 3])
def test_perplexity(docs, limit):
    tokens = {d: words_of(t)[:limit] for d, t in TEXTS.items()}
    pairs = {d: list(zip(t, t[1:])) for d, t in tokens.items()}
    two = Counter(p for ps in pairs.values() for p in ps)
    one = Counter(p[0] for ps in pairs.values() for p in ps)
    v = len({w for p in two for w in p})
    got = {r.doc_id: r.perplexity for r in text_stats.perplexity(docs, max_tokens=limit).collect()}
    for d, ps in pairs.items():
        if not ps:
            assert got[d] is None
            continue
        ll = sum(math.log((two[p] + 0.1) / (one[p[0]] + 0.1 * v)) for p in ps)
        assert got[d] == pytest.approx(math.exp(-ll / len(ps)))
    flagged = text_stats.generated_text_flag(text_stats.perplexity(docs), 3.0).collect()
    assert not [r for r in flagged if r.perplexity is None and r.is_suspicious_ai]


def test_repetition_and_buzzwords(docs):
    out = {
        r.doc_id: (r.a, r.b)
        for r in docs.select(
            "doc_id",
            text_stats.repetition_ratio(F.col("text")).alias("a"),
            text_stats.buzzword_density(F.col("text"), ["The", "mat"]).alias("b"),
        ).collect()
    }
    assert out[6] == (pytest.approx(0.5), 1.0)
    assert out[1] == (0.0, pytest.approx(0.5))
    assert out[3] == (None, None) and out[5] == (None, 0.0)


def test_maxsim_against_numpy(spark):
    rng = np.random.default_rng(3)
    size = {d: int(rng.integers(0, 6)) for d in range(12)}
    vecs = {d: rng.normal(size=(n, 8)).astype(np.float32) for d, n in size.items()}
    vecs[3] = np.zeros((2, 8), dtype=np.float32)
    vecs[4] = np.vstack([np.zeros(8), np.ones(8), np.ones(8)]).astype(np.float32)
    lists = spark.createDataFrame(
        [(d, v.tolist()) for d, v in vecs.items()], "doc_id int, vectors array<array<float>>"
    )
    apps = spark.createDataFrame([(i * 12 + j, i, j) for i in range(12) for j in range(13)], "app_id int, jd_id int, resume_id int")
    got = {(r.jd_id, r.resume_id): r for r in matching.chunk_maxsim(apps, lists, lists).collect()}
    cross = {(r.jd_id, r.resume_id): r for r in matching.chunk_cross(apps, lists, lists).collect()}
    best = {(r.jd_id, r.resume_id, r.jd_chunk): r.resume_chunk for r in matching.best_chunk(apps, lists, lists).collect()}

    def unit(m):
        with np.errstate(invalid="ignore"):
            return m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)

    for i in range(12):
        for j in range(13):
            a, b = vecs[i], vecs.get(j, np.zeros((0, 8)))
            if not len(a) or not len(b) or np.isnan(unit(a) @ unit(b).T).all():
                assert got[i, j].score is None, (i, j)
                continue
            s = unit(a) @ unit(b).T
            if np.isnan(s).all(axis=1).any():
                assert got[i, j].score is None
                continue
            assert got[i, j].score == pytest.approx(np.nanmax(s, axis=1).mean())
            assert cross[i, j].pairs == s.size and cross[i, j].lowest == pytest.approx(np.nanmin(s))
            for c in range(len(a)):
                assert best[i, j, c] == int(np.nanargmax(s[c]))
    assert got[4, 4].score is None
    for i in (d for d in size if size[d] and d not in (3, 4)):
        assert got[i, i].score == pytest.approx(1.0)


def test_vector_columns(spark):
    df = spark.sql("SELECT array(3f, 4f) a, array(0f, 0f) z, array(4f, 3f) b")
    row = df.select(
        vectors.l2_normalise(F.col("a")), vectors.l2_normalise(F.col("z")), vectors.cosine(F.col("a"), F.col("b")),
        vectors.cosine(F.col("a"), F.col("z")), vectors.distance(F.col("a"), F.col("b")),
        vectors.vector_match(F.col("a"), F.col("b")), vectors.vector_match(F.col("a"), F.col("a")),
    ).first()
    assert tuple(row) == ([0.6, 0.8], [0.0, 0.0], pytest.approx(0.96), None, pytest.approx(math.sqrt(2)), False, True)


def test_embedding(spark, docs):
    out = {r.doc_id: r.vector for r in ml.embed(docs).collect()}
    assert {len(v) for v in out.values()} == {ml.DIMENSIONS}
    assert np.linalg.norm(out[1]) == pytest.approx(1.0, abs=1e-6) and not any(out[3])
    again = {r.doc_id: r.vector for r in ml.embed(docs).collect()}
    assert again == out


def test_own_encoder(docs):
    def lengths(df, text, out):
        return df.withColumn(out, F.array(F.length(text).cast("float")))
    assert {r.doc_id: r.vector for r in ml.embed(docs, encoder=lengths).collect()}[5] == [3.0]


def test_classifier_learns_and_reloads(spark, small):
    vecs = Entities(spark, small).table("embeddings").select("vec_id", F.col("embedding").alias("vector"), (F.col("label") % 7).alias("label"))
    model = ml.fit_category_model(vecs, trees=5)
    out = ml.category_classify(vecs, ml.loaded_model(ml.saved_model(spark, model)))
    assert out.where("category is null").count() == 0
    assert out.where("label = prediction").count() > out.count() / 7


def test_whole_chain_on_documents(spark, small):
    """Cleaned texts hold nothing but what the chain keeps."""
    docs = Entities(spark, small).documents().select(cleaning.clean_text(F.col("text")).alias("t"))
    assert docs.where(F.col("t").rlike(r"[^ a-z0-9.,!?:;'-]|  |@|---")).count() == 0
