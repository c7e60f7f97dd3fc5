"""Each operator against a plain version, and on rows that are out of the ordinary."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import (
    bpe,
    decision_list,
    histogram_sort,
    knn_quality,
    language_id,
    log_bilinear,
    order_minhash,
    packing,
    simhash,
    url_filter,
)
from rankloom.llm.queries import QUERIES, url_rules

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

WORDS = [a + b for a in ("sun", "le", "tor", "ba", "ri", "über") for b in ("ne", "do", "ka", "li", "ém")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Ordinary texts, null and empty ones, repeated rows, ties, odd characters, one very long."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[0], texts[0] + " x", "", None, " \t\n", "a", "x" * 5000, "Ω²½ \x1f\x85 'll don't", sentence(rng, 30_000)]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, texts[4]), (None, None), (7, "another text under the same id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With further columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    extra = ("n", "score", "rank", "length", "shard", "word", "fingerprint", "start", "lang", "source")
    return df.withColumns({name: F.lit("clash") for name in extra})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def plain_simhash(text, shingle=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits):
    """Smallest index reachable, by all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(prints))]


# ---- 1 -----------------------------------------------------------------------


def plain_edited(rows):
    kept = sorted({(k, t or "") for k, t in rows if k is not None}, reverse=True)
    kept += [(None, t) for t in {t or "" for k, t in rows if k is None}]
    return kept


def test_order_minhash_edits(spark, rows, docs):
    ids = [r for r in rows if r[0] is not None and r != (7, "another text under the same id")]
    df = docs.where("doc_id is not null and text is distinct from 'another text under the same id'")
    got = {r.doc_id: r for r in order_minhash.edited_pairs(df).collect()}
    ring = plain_edited(ids)
    assert len(got) == len(ring)
    for (k, t), (_, after) in zip(ring, ring[1:] + ring[:1], strict=True):
        cut = len(t) // 3
        assert (got[k].n_chars, got[k].edited) == (len(t), t[: len(t) - cut] + after[:cut])


def test_order_minhash_follows_order_and_edits(spark):
    rng = random.Random(1)
    base = sentence(rng, 400).split()
    moved = base[200:] + base[:200]
    near = base[:380] + sentence(rng, 20).split()
    texts = {"base": base, "near": near, "swapped": moved, "far": sentence(random.Random(9), 400).split()}
    s = order_minhash.sketch(F.col("t"))
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, t string").select("k", s.alias("s"))
    got = {r.k: r.l for r in df.crossJoin(df.where("k = 'base'").select(F.col("s").alias("b"))).select(
        "k", order_minhash.likeness(F.col("s"), F.col("b")).alias("l")).collect()}
    assert got["base"] == 1.0
    assert got["near"] > got["swapped"] > got["far"]


def test_order_minhash_tells_repeats_apart(spark):
    df = spark.createDataFrame([("a b c " * n,) for n in (1, 5, 9)] + [("",), (None,)], "t string")
    sketches = [tuple(r.s) for r in df.select(order_minhash.sketch(F.col("t")).alias("s")).collect()]
    assert len(set(sketches[:3])) == 3 and sketches[3:] == [(), ()]


def test_order_minhash_of_no_rows(none):
    assert order_minhash.edited_pairs(none).count() == 0


# ---- 2 -----------------------------------------------------------------------


def test_shards(rows, docs):
    got = histogram_sort.sharded(docs.where("length(text) < 10000 or text is null"), 5).collect()
    small = [r for r in rows if r[1] is None or len(r[1]) < 10_000]
    assert sorted(Counter((r.doc_id, r.text) for r in got).items(), key=str) == sorted(Counter(small).items(), key=str)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 8
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_are_even_with_a_third_of_equal_texts(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")
    )
    sizes = [r.n for r in histogram_sort.sharded(df, 7).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 2 * 13 + 0.004 * sum(sizes) / 7


def test_shards_of_no_rows(none):
    assert histogram_sort.sharded(none, 3).count() == 0


# ---- 3 -----------------------------------------------------------------------


@pytest.mark.parametrize("longest", [0, 64])
def test_near_duplicates(rows, docs, longest):
    got = simhash.near_duplicates(docs, longest=longest).collect()
    prints = [plain_simhash(t) for _, t in rows]
    groups = plain_components(prints, 2)
    least = {}
    for (k, _), g in zip(rows, groups, strict=True):
        if k is not None:
            least[g] = min(k, least.get(g, k))
    want = Counter((k, p, least.get(g)) for (k, _), p, g in zip(rows, prints, groups, strict=True))
    assert Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == want


@pytest.mark.parametrize(("bits", "longest"), [(0, 64), (1, 64), (1, 0), (2, 64), (2, 0)])
def test_links_of_crowded_fingerprints(spark, bits, longest):
    rng = random.Random(bits)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for base in (0, 1 << 63, 12345) for _ in range(60)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fingerprint long")
    roots = simhash.components(df.withColumn("label", F.col("fingerprint")), simhash.links(df, bits, longest))
    got = {}
    for r in roots.collect():
        got.setdefault(r.root, set()).add(r.fingerprint % (1 << 64))
    want = {}
    for p, g in zip(prints, plain_components(prints, bits), strict=True):
        want.setdefault(g, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_survivors_keep_one_of_each_group(rows, docs):
    got = simhash.survivors(docs)
    assert got.columns == docs.columns
    prints = [plain_simhash(t) for _, t in rows]
    kept = [plain_simhash(r.text) for r in got.collect()]
    groups = plain_components(prints, 2)
    assert sorted(groups[prints.index(p)] for p in kept) == sorted(set(groups))


def test_near_duplicates_of_no_rows(none):
    assert simhash.near_duplicates(none).count() == simhash.survivors(none).count() == 0


# ---- 4 -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as file:
        return bpe.Coder(bpe.read_ranks(file.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.vocabulary.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abe TH'ls \n\t.é12\x1f\x85½中", max_size=80))
def test_bpe_is_the_librarys(coder, library, text):
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=20), st.integers(0, 40), st.integers(0, 40))
def test_bpe_appends_and_edits(coder, data, more, start, length):
    whole = lambda x: bpe.Prefixes(coder.vocabulary, x).ids()
    p = bpe.Prefixes(coder.vocabulary, data)
    p.append(more)
    assert p.ids() == whole(data + more) and p.ids(len(data)) == whole(data)
    start = min(start, len(data))
    p.replace(start, start + length, b"edit")
    joined = data + more
    assert p.ids() == whole(joined[:start] + b"edit" + joined[start + length :])


def test_bpe_query_rows(rows, docs, none, library):
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.coded(docs, RANKS, public_tokenizers.PATTERN).collect())
    want = Counter((k, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t in rows)
    assert got == want
    assert bpe.coded(none, RANKS, public_tokenizers.PATTERN).count() == 0


# ---- 5 -----------------------------------------------------------------------


def test_language_model_is_normalised_and_counts_right(rows, docs, none):
    learn = docs.where("doc_id % 7 != 2")
    model, counted = log_bilinear.fit(learn, vocabulary=10, frequent_words=15)
    c = Counter(w for k, t in rows if k is not None and k % 7 != 2 for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    got = log_bilinear.scored(docs, model, counted).collect()
    want = []
    for k, t in rows:
        words = [*(t or "").encode().lower().split(), b""]
        want.append((k, len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 5)))
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got)
    classes = np.arange(len(model.parameters.output))
    for first, second in ((2, 3), (len(classes), len(classes)), (0, 5)):
        logs = model.log10(classes, np.full_like(classes, first), np.full_like(classes, second))
        assert abs((10**logs).sum() - 1) < 1e-4
    rare = sum(x + 1 for w, x in c.items() if w and w.decode() not in model.ids) + 1
    assert model.rare_weight == rare
    assert log_bilinear.scored(none, model, counted).count() == 0
    empty, nothing = log_bilinear.fit(none)
    assert log_bilinear.scored(docs, empty, nothing).where("base_score = 0 and n_known = 0").count() == len(rows)


def test_noise_contrastive_steps_learn_the_context():
    rng = np.random.default_rng(0)
    ids = np.tile([2, 3, 4, 5], 4000) + 0
    ids[rng.random(len(ids)) < 0.05] = 0
    counts = np.bincount(ids, minlength=6).astype(float)
    trainer = log_bilinear.Trainer(log_bilinear.start(counts, 8), counts)
    first, second = np.roll(ids, 1), np.roll(ids, 2)
    m = lambda p: log_bilinear.Model(p, {}, {}, 0, 0, 1.0)
    before = m(log_bilinear.start(counts, 8)).log10(ids, first, second).mean()
    for _ in range(60):
        trainer.text(ids, first, second)
    assert m(trainer.p).log10(ids, first, second).mean() > before + 0.2


# ---- 6 -----------------------------------------------------------------------


def plain_statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    covered = {j for i, g in enumerate(grams) if c[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics_and_base_rules(spark, rows, docs, none):
    more = [(100, "a b c a b c"), (101, "x y\nx y\n \n\nx y\n|| <>"), (102, "w " * 400), (103, "one two three " * 2 + sentence(random.Random(2), 60))]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = decision_list.quality_rules(df, labels).collect()
    want = Counter()
    for k, t in [*rows, *more]:
        s = plain_statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want[(k, *s, failed, not failed)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert decision_list.quality_rules(none, labels).count() == 0


def test_learned_rules_split_what_is_separable(spark):
    rng = random.Random(3)
    texts = [(i, sentence(rng, 80)) for i in range(60)]
    texts += [(i, " ".join(w + "***" for w in sentence(rng, 80).split())) for i in range(60, 100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    measured = decision_list.with_statistics(docs)
    rules = decision_list.learn(decision_list.labelled_features(measured, labels))
    assert len(rules.rules) == 1
    assert sorted(r.doc_id for r in decision_list.quality_rules(docs, labels).where("kept").collect()) == list(range(60))
    kept = decision_list.accepted(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))


# ---- 7 -----------------------------------------------------------------------


def test_language_id(spark, docs, none):
    texts = [(i, "the sun and the moon are in the sky", "en") for i in range(5)]
    texts += [(i, "die sonne und der mond sind am himmel", "de") for i in range(5, 9)] + [(9, None, "en"), (10, "x", None)]
    model = language_id.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    asked = ["THE SKY", "der himmel", "himmels", "skyx", "", None, "12 !!", "中文"]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predicted(df, model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["en", "de", "de", "en", "und", "und", "und"]
    assert got[7].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predicted(docs, model).count() == docs.count()
    nothing = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predicted(docs, nothing).collect()} == {"und"}


def test_language_id_does_not_depend_on_what_travels(spark):
    rng = random.Random(6)
    en, es = ([a + b + e for a in ("sun", "le", "tor") for b in ("ne", "do", "ka")] for e in ("th", "ción"))
    shared = ["gato", "mar", "sol"]
    texts = [(i, " ".join(rng.choices(en + shared[:1], k=40)), "en") for i in range(60)]
    texts += [(60 + i, " ".join(rng.choices(es + shared, k=8)), "es") for i in range(4)]
    learn = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    asked = [*(t for _, t, _ in texts), "mar sol", "gato", "leción", "torz qq", "中", "mar " * 9 + "sunneth", None, ""]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(3)
    got = [
        {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(df, language_id.fit(learn, *most)).collect()}
        for most in ((1000, 10_000), (5, 12), (0, 0))
    ]
    assert [got[0][i][0] for i in range(60, 66)] == ["es"] * 4 + ["es", got[0][65][0]]
    for other in got[1:]:
        assert {k: v[0] for k, v in other.items()} == {k: v[0] for k, v in got[0].items()}
        assert all(abs(v[1] - got[0][k][1]) < 1e-9 for k, v in other.items())


# ---- 8 -----------------------------------------------------------------------


def test_packing(rows, docs, none):
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    got = packing.tokenised(docs, VOCABULARY, window=64).collect()
    want = Counter()
    for k, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 64):
            want[(k, at, len(ids[at : at + 64]), len(ids), np.array(ids[at : at + 64], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, bytes(r.ids)) for r in got) == want
    packed = packing.pack(packing.tokenised(docs, VOCABULARY, window=64), window=64).collect()
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, bytes(r.ids)) for r in packed) == want
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.tokenised(none, VOCABULARY)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abE'sé.,!*Σß½1 \n\t\x1f\x85İ\u0301<|>ſ…中", max_size=60))
def test_word_coder_is_the_librarys(text):
    import pyarrow as pa

    c = _word_coder()
    [ids] = list(c.encode(pa.array([text])))
    assert ids.tolist() == c.tokenizer.encode(text, add_special_tokens=False).ids


_CODERS = []


def _word_coder():
    if not _CODERS:
        with open(VOCABULARY, encoding="utf-8") as file:
            _CODERS.append(packing.WordCoder(file.read()))
    return _CODERS[0]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 4), max_size=8), st.integers(0, 60))
def test_closest_fill_is_the_best_sum(counts, room):
    fill = packing.closest_fill(counts, room)
    assert all(fill[x] <= counts[x] for x in fill)
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    assert sum(x * k for x, k in fill.items()) == max(s for s in sums if s <= room)


# ---- 9 -----------------------------------------------------------------------


def test_neighbours_vote(spark, docs, none):
    rng = random.Random(4)
    good = [(i, sentence(rng, 60)) for i in range(60)]
    bad = [(i, sentence(rng, 60).upper().replace(" ", "!! ")) for i in range(60, 100)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = knn_quality.fit(df, labels, usable=knn_quality.learnable())
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    assert len(model.vectors) == len(learned)
    scores = {r.doc_id: r.score for r in knn_quality.score(df, model).collect()}
    assert all((scores[i] >= 0.3) == (i < 60) for i in range(100))
    # Blocked products against one by one.
    texts = [t.encode() for _, t in good[:5]]
    vectors = model.vectors_of(texts)
    for text, vector in zip(texts, vectors, strict=True):
        cosines = np.array([vector @ v for v in model.vectors])
        near = np.argsort(-cosines)[: model.neighbours]
        weight = np.maximum(cosines[near], 0) ** knn_quality.SHARPNESS * model.votes[near]
        assert abs(model.scores([text])[0] - (weight * model.labels[near]).sum() / weight.sum()) < 1e-3
    assert model.scores([b""])[0] == pytest.approx(model.prior)
    assert knn_quality.score(docs, model).count() == docs.count()
    kept = knn_quality.accepted(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    unlearned = knn_quality.fit(none, labels.where("false"))
    assert {r.score for r in knn_quality.score(docs, unlearned).collect()} == {0.5}


# ---- 10 ----------------------------------------------------------------------


def test_url_rules(spark):
    urls = {
        "https://a.example.org/es/x": ("example.org/es/", "block"), "http://EXAMPLE.org/en/12?q": ("example.org/en/1", "block"),
        "https://example.org": (None, "allow"), "http://x.org/": ("org/", "allow"), "http://b.com/de/": ("com/de/", "block"),
        "http://b.com/fr/1#t": ("com/fr/", "allow"), "http://m.casino-win.com/en/": (None, "block"),
        "http://casino-winner.com/": (None, "allow"), "http://notorg/": (None, "allow"), "example.org/es/": (None, "allow"),
        "": (None, "allow"), None: (None, "allow"), "http://example.org/Es/": ("org/", "allow"), "x://y://z.org/q": (None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(df, url_rules()).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    assert url_filter.judged(df.where("false"), url_rules()).count() == 0


def test_index_finds_what_all_patterns_find(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("url").collect()
    rules = url_rules()
    index = url_filter.Index(rules, url_filter.token_counts(spark.read.parquet(f"{small}/pages.parquet"), rules))
    for (url,) in pages:
        host, path = url_filter.host_and_path(url)
        assert set(index.fitting(host, path)) == {r for r in rules if re.compile(r.pattern, re.DOTALL).match(host + path)}


# ---- queries -----------------------------------------------------------------


# op13_spelling returns words, not the rows of a table.
@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("op13")))
def test_query_returns_every_row(spark, small, name):
    df = QUERIES[name](spark, small)
    key, table = {"op10": ("page_id", "pages"), "op11": ("vec_id", "embeddings")}.get(name[:4], ("doc_id", "documents"))
    whole = spark.read.parquet(f"{small}/{table}.parquet")
    assert df.select(key).distinct().count() == whole.count()
    assert len(set(df.columns)) == len(df.columns)


def test_held_out_accuracy(spark, small):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op7_language_id"](spark, small).where("held_out").collect()
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) > 0.95 * len(got)


def test_digests(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op2_histogram_sort"](spark, small).collect():
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode()))
    for r in QUERIES["op4_byte_bpe"](spark, small).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
