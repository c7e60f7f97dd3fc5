"""Models of a corpus on texts they were not taken from, encoders and drawn tests."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import cleaning
from rankloom.operators import ml, relations, sampling, skills, text_stats
from rankloom.sources import readers

WORDS = "alpha beta gamma delta one two three four".split()


def corpus(seed, n, first=0):
    rng = random.Random(seed)
    return [(first + i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_counted_is_a_counter(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice("abcde") for _ in range(rng.randint(0, 40))]) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, t array<string>")
    got = {r.i: r.c for r in df.select("i", text_stats.counted(F.col("t")).alias("c")).collect()}
    for i, items in rows:
        assert (None if got[i] is None else {r["item"]: r["n"] for r in got[i]}) == (None if items is None else Counter(items))


def test_merged_term_models_equal_one_of_all(spark, tmp_path):
    one, two = corpus(1, 20), corpus(2, 15, 100)
    whole = text_stats.TermModel.fit(frame(spark, one + two))
    text_stats.TermModel.fit(frame(spark, one), path=f"file://{tmp_path}/one")
    merged = text_stats.TermModel(spark, f"file://{tmp_path}/one").merged(text_stats.TermModel.fit(frame(spark, two)))
    rows = lambda m: (sorted(map(tuple, m.frequencies().collect())), m.documents().first().n)
    assert rows(merged) == rows(whole)


def test_weights_of_unseen_texts(spark):
    seen = corpus(3, 25)
    new = [(1, "alpha alpha beta unheard"), (2, "unheard words"), (3, None), (4, "")]
    model = text_stats.TermModel.fit(frame(spark, seen))
    weights = {(r.doc_id, r.term): r.weight for r in text_stats.tfidf(frame(spark, new), model=model).collect()}
    df = Counter(w for _, t in seen for w in set(t.split()))
    idf = {w: math.log((1 + len(seen)) / (1 + n)) + 1 for w, n in df.items()}
    a, b = 2 * idf["alpha"], idf["beta"]
    length = math.hypot(a, b)
    assert weights == pytest.approx({(1, "alpha"): a / length, (1, "beta"): b / length})
    flags = text_stats.stuffing_flag(frame(spark, new), text_stats.tfidf(frame(spark, new), model=model)).collect()
    assert {r.doc_id: r.is_suspicious for r in flags} == {1: True, 2: False, 3: False, 4: False}


def test_perplexity_of_unseen_texts(spark):
    one, two = corpus(4, 12), corpus(5, 12, 50)
    model = text_stats.PairModel.fit(frame(spark, one)).merged(text_stats.PairModel.fit(frame(spark, two)))
    pairs = Counter(p for _, t in one + two for p in zip(t.split(), t.split()[1:]))
    firsts = Counter()
    for (a, _), n in pairs.items():
        firsts[a] += n
    v = len({w for p in pairs for w in p})
    new = [(1, "alpha beta beta"), (2, "alpha unheard gamma"), (3, "unheard thing"), (4, "alone"), (5, None)]
    got = {r.doc_id: r.perplexity for r in text_stats.perplexity(frame(spark, new), model=model).collect()}
    for i, t in new:
        p = list(zip((t or "").split(), (t or "").split()[1:]))
        logs = [math.log((pairs[x] + 0.1) / (firsts[x[0]] + 0.1 * v)) for x in p]
        assert got[i] == (pytest.approx(math.exp(-sum(logs) / len(p))) if p else None)
    assert got[3] == pytest.approx(v)  # equally likely words


def test_no_text_is_exchanged(spark):
    plan = text_stats.term_counts(frame(spark, corpus(6, 5)).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the frame's own repartition
    plan = text_stats.pair_counts(frame(spark, corpus(6, 5)).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_batches_by_length_and_one_load(spark, tmp_path):
    loads = f"{tmp_path}/loads"

    def load():
        with open(loads, "a") as f:
            f.write("x")

        def model(texts):
            assert len(texts) <= 4 and [len(t) for t in texts] == sorted(len(t) for t in texts)
            return np.array([[len(t), t.count("a"), 1] for t in texts], dtype=np.float32)

        return model

    encoder = ml.batch_encoder(f"test-{tmp_path}", load, batch=4)
    rows = [(i, t) for i, t in corpus(7, 50)] + [(900, None), (901, "")]
    got = {r.doc_id: r.v for r in encoder(frame(spark, rows), "text", "v").collect()}
    for i, t in rows:
        plain = np.array([len(t or ""), (t or "").count("a"), 1], dtype=np.float32)
        assert got[i] == pytest.approx(list(plain / np.linalg.norm(plain)), abs=1e-6)
    with open(loads) as f:
        assert 1 <= len(f.read()) <= 4  # local[4]: at most one for each worker


def test_zero_vectors_stay_zero(spark):
    encoder = ml.batch_encoder("zero", lambda: lambda texts: np.zeros((len(texts), 2)))
    assert encoder(frame(spark, [(1, "x")]), "text", "v").first().v == [0.0, 0.0]


def test_each_candidate_draws_without_repeats(spark):
    questions = [(i, "c", "basic", kind) for i, kind in enumerate(["mcq"] * 20 + ["code"] * 3 + ["subjective"] * 5 + ["other"] * 9)]
    q = spark.createDataFrame(questions, "question_id int, category string, difficulty string, question_type string")
    starts = spark.createDataFrame(
        [(i, "c", "basic") for i in range(300)] + [(999, "none", "basic"), (998, None, "basic")],
        "candidate_id int, category string, difficulty string",
    )
    rows = sampling.test_per_candidate(starts, q, "s").collect()
    again = sampling.test_per_candidate(starts.repartition(5), q, "s").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    drawn: dict = {}
    for r in rows:
        drawn.setdefault((r.candidate_id, r.question_type), {})[r.draw] = r.question_id
    kinds = {i: k for i, _, _, k in questions}
    assert {c for c, _ in drawn} == set(range(300))
    for (_, kind), by in drawn.items():
        n = {"mcq": 8, "code": 3, "subjective": 5}[kind]
        assert sorted(by) == list(range(1, n + 1)) and len(set(by.values())) == n
        assert all(kinds[x] == kind for x in by.values())
    # Every question and every place is about equally likely.
    held = Counter(x for (_, kind), by in drawn.items() if kind == "mcq" for x in by.values())
    assert len(held) == 20 and 80 <= min(held.values()) and max(held.values()) <= 165
    first = Counter(by[1] for (_, kind), by in drawn.items() if kind == "mcq")
    assert len(first) == 20 and max(first.values()) <= 35


def test_undecodable_bytes_as_python_drops_them(spark):
    rng = random.Random(8)
    raw = [b"", b"plain", "� é 😀".encode(), b"\xff\xfe", b"a\xe2\x82b", b"\xed\xa0\x80x", b"\xf4\x90\x80\x80", b"\xc0\xafz", b"x\xf0\x9f\x98"]
    raw += [bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xEF, 0xBF, 0xBD]) for _ in range(30)) for _ in range(200)]
    raw.append(b"long " * 50_000 + b"\xff" + "ü".encode() * 50_000)
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    got = {r.i: r.t for r in df.select("i", readers.decoded(F.col("b")).alias("t")).collect()}
    for i, b in enumerate(raw):
        assert got[i] == b.decode("utf-8", errors="ignore")


def test_only_texts_that_may_change_leave_for_python(spark, small):
    odd = ["é", "각", "̈́", "Å", "ạ̇", "क़", "é", "😀 ok", None, "", "x\r\ny\rz", "ো"]
    rng = random.Random(9)
    odd += ["".join(chr(rng.choice([0x41, 0x301, 0x323, 0xE9, 0x1100, 0x1161, 0x11A8, 0x9C7, 0x9BE, 0x20, 0x3099, 0x304B])) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    got = {r.i: r.t for r in df.select("i", cleaning.nfc_newlines(F.col("t")).alias("t")).collect()}
    plain = lambda t: t if t is None else unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n")
    for i, t in enumerate(odd):
        assert got[i] == plain(t)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    rows = docs.select("text", cleaning.nfc_newlines(F.col("text")).alias("t"))
    assert all(r.t == plain(r.text) for r in rows.collect())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [_nfc(CASE WHEN RLIKE(" in plan


def test_cascade_goes_all_the_way(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (3,)], "a int"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "b int, of int"),
        "c": spark.createDataFrame([(100, 10, 3), (101, 11, 3), (102, 12, 1), (103, None, None)], "c int, b int, a int"),
        "d": spark.createDataFrame([(100,), (101,), (102,), (103,), (999,)], "c int"),
    }
    refs = [("b", "of", "a"), ("c", "b", "b"), ("c", "a", "a"), ("d", "c", "c")]
    keys = {"a": "a", "b": "b", "c": "c"}
    left = relations.cascade(tables, keys, refs, {"a": spark.createDataFrame([(1,), (1,)], "a int")})
    held = {name: sorted(r[0] for r in df.collect()) for name, df in left.items()}
    assert held == {"a": [2, 3], "b": [11, 12], "c": [101, 103], "d": [101, 103, 999]}
    nothing = relations.cascade(tables, keys, refs, {})
    assert all(nothing[name].count() == df.count() for name, df in tables.items())
    with pytest.raises(ValueError):
        relations.cascade(tables, keys, [*refs, ("a", "a", "c")], {})


@pytest.mark.parametrize(("text", "tokens"), [
    ("Don't stop, it's fine.", "do n't stop , it 's fine ."),
    ("I can't; we won't!", "i ca n't ; we wo n't !"),
    ("cannot gonna gotta lemme", "can not gon na got ta lem me"),
    ("they're I'd you'll we've i'm", "they 're i 'd you 'll we 've i 'm"),
    ("e.g. this, i.e. that, etc.", "e.g. this , i.e. that , etc."),
    ("Dr. No vs. Mr. X, Inc.", "dr. no vs. mr. x , inc."),
    ("at 5 p.m., feb.. (e.g.)", "at 5 p.m. , feb. . ( e.g. )"),
    ("isn't. mayn't don'ts o'neill's", "is n't . mayn't don'ts o'neill 's"),
    ("node.js .net python. pci-dss e.g.x", "node.js .net python . pci - dss e.g.x"),
])
def test_words_that_are_two_and_abbreviations(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(skills.tokenise(F.col("t"))).first()[0] == tokens.split()
