"""Texts coded in blocks: the same numbers as row by row, and nothing left behind on disk."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankloom import session
from rankloom.operators import blocks, hot_groups, skills, text_stats
from rankloom.operators.ranking import by_score
from rankloom.plans.registry import QUERIES
from rankloom.session import settled, written

SCHEMA = "doc_id long, text string"


def _rows(n=40):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["éé", "中文"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n)]
    return [*rows, (3, "w1 w1 w2 w9"), (3, rows[3][1]), (None, "w1 w2 lost"), (n, None), (n + 1, "alone"), (n + 2, "")]


def _perplexities(rows, smoothing=0.1):
    texts = [(i, (t or "").split()) for i, t in rows if i is not None]
    pairs, first = Counter(), Counter()
    for _, t in texts:
        pairs.update(zip(t, t[1:], strict=False))
        first.update(t[:-1])
    v = len({w for p in pairs for w in p})
    sums = defaultdict(lambda: [0.0, 0])
    for i, t in texts:
        for a, b in zip(t, t[1:], strict=False):
            sums[i][0] += math.log((pairs[a, b] + smoothing) / (first[a] + v * smoothing))
            sums[i][1] += 1
    return {i: math.exp(-s / n) for i, (s, n) in sums.items()}


def _weights(rows):
    n = len(rows)
    texts = [(i, Counter((t or "").split())) for i, t in rows if i is not None]
    df = Counter(w for _, t in texts for w in t)
    raw = [(i, w, c * (math.log((1 + n) / (1 + df[w])) + 1)) for i, t in texts for w, c in t.items()]
    squares = Counter()
    for i, _, x in raw:
        squares[i] += x * x
    return sorted((i, w, round(x / math.sqrt(squares[i]), 9)) for i, w, x in raw)


@pytest.mark.parametrize("sizes", [None, (64, 100, 3), (1, 1, 1)])
def test_blocks_of_any_size(spark, monkeypatch, sizes):
    if sizes:
        for module, name, value in zip((blocks, blocks, text_stats), ("PART_BYTES", "BLOCK_BYTES", "PAIR_PARTS"), sizes, strict=True):
            monkeypatch.setattr(module, name, value)
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.doc_id, r.perplexity) for r in text_stats.perplexity(docs).collect() if r.perplexity is not None}
    wanted = _perplexities(rows)
    assert {i: round(p, 9) for i, p in got} == {i: round(p, 9) for i, p in wanted.items()}
    weights = sorted((r.doc_id, r.term, round(r.weight, 9)) for r in text_stats.tfidf(docs).collect())
    assert weights == _weights(rows)


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], SCHEMA)
    assert {r.perplexity for r in text_stats.perplexity(docs).collect()} == {None}
    assert text_stats.tfidf(docs).collect() == []
    assert text_stats.perplexity(docs.limit(0)).collect() == []


def test_phrases_in_blocks_of_any_size(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["red", "deep", "sea", "of", "stone"], k=rng.randint(0, 25)))) for i in range(20)]
    rows += [rows[4], (None, "deep sea"), (20, None)]
    phrases = [("Deep sea",), ("sea",), ("red deep sea",), ("stone of",), ("nowhere",)]
    wanted = Counter()
    for i, text in rows:
        t = (text or "").split()
        for (phrase,) in phrases:
            p = phrase.lower().split()
            wanted[i, phrase.lower()] += sum(t[k:k + len(p)] == p for k in range(len(t)))
    gazetteer = skills.gazetteer(spark.createDataFrame(phrases, "phrase string"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    for size in (1, 200, 1 << 23):
        monkeypatch.setattr(blocks, "PART_BYTES", size)
        monkeypatch.setattr(skills, "PART_BYTES", size)
        found = skills.skill_match(docs, gazetteer)
        assert {(r.doc_id, r.skill): r.hits for r in found.collect()} == {k: n for k, n in wanted.items() if n}
    assert skills.skill_match(docs, gazetteer.limit(0)).collect() == []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "_run" not in plan


def test_packed_numbers():
    for numbers in ([], [0], [255, 0, 7], [256], [1 << 40, 3]):
        assert blocks.unpacked(blocks.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_one_row_for_a_list_of_pairs(spark, monkeypatch):
    """What meets the counts is a row for a list of pairs, not one for a pair."""
    monkeypatch.setattr(text_stats, "PAIR_PARTS", 2)
    seen = []
    for module in (blocks, text_stats):
        monkeypatch.setattr(module, "written", lambda df, name, **o: seen.append((name, w := written(df, name, **o))) or w)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(200))) for i in range(5)], SCHEMA).coalesce(1)
    text_stats.perplexity(docs).collect()
    tables = dict(seen)
    assert "pair-counts" not in tables
    assert tables["coded-texts"].count() == 1 and tables["pair-lists"].count() == 3


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """The names of the tables in a shared folder of the test's own."""
    folder = tmp_path / "shared"
    monkeypatch.setattr(session, "shared_folder", lambda spark: f"file://{folder}")
    return lambda: sorted(x.rpartition("-")[0] for x in os.listdir(folder))


def test_tables_on_the_way_go(spark, shared):
    def made():
        one = written(spark.range(5), "one")
        return settled(lambda: written(one, "two").union(one), "three")

    assert settled(made, "four").count() == 10
    assert shared() == ["four"]


def test_a_written_table_leaves_no_shuffle_files(spark):
    df = spark.range(1000).repartition(3).groupBy("id").count()
    def kept():
        known = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
        return set(known.keySet().mkString(",").split(","))

    before = kept()
    written(df, "counts")
    assert kept() <= before


def test_the_order_is_not_stored(spark, monkeypatch):
    """A large group takes its rows on disk, without a second copy of what orders them."""
    seen = []
    monkeypatch.setattr(hot_groups, "written", lambda df, name, **o: seen.append(df) or written(df, name, **o))
    rows = [(g, k, float(k % 7)) for g in (1, None) for k in range(50)]
    df = spark.createDataFrame(rows, "g long, app_id long, score double").repartition(3)
    got = {(r.g, r.app_id): (r.rank, r.group_rows) for r in hot_groups.ranked(df, ["g"], by_score("score", "app_id")).collect()}
    order = sorted(range(50), key=lambda k: (-(k % 7), k))
    assert got == {(g, k): (i + 1, 50) for g in (1, None) for i, k in enumerate(order)}
    assert seen[0].columns == ["g", "app_id", "score", "_at", "_part"]


def _tables(spark, folder):
    """Tables of some rows for the ranking of a job's applications."""
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choices(["red", "blue", "deep", "sea", "stone", "of", "the"], k=60)), "en", "web") for i in range(12)]
    parts = [(i, f"{a} {b}", "SMALL TIN") for i, (a, b) in enumerate([("red", "sea"), ("deep", "blue"), ("stone", "red")])]
    orders = [(i, i % 3, float(i % 5), "O", None) for i in range(30)]
    for name, rows, schema in (
        ("documents", texts, "doc_id long, text string, lang string, source string"),
        ("part", parts, "p_partkey long, p_name string, p_type string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderdate timestamp_ntz"),
        ("supplier", [(0,), (1,)], "s_suppkey long"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_job_ranking_keeps_only_what_its_result_reads(spark, shared, tmp_path):
    _tables(spark, tmp_path / "in")
    rows = QUERIES["job_ranking"](spark, str(tmp_path / "in")).collect()
    assert shared() == ["document-flags", "ranked"]
    assert sorted(r.app_id for r in rows) == list(range(30)) and all(r.skills for r in rows)
    assert {(r.job_id, r.rank) for r in rows} == {(j, k) for j in range(3) for k in range(1, 11)}
