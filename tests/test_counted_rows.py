"""Runs of tokens are counted as numbers in a task; word pairs meet as numbers in the join."""

import random
from collections import Counter

from pyspark.sql import functions as F

from rankloom.operators import text_stats


def _rows(spark):
    rng = random.Random(7)
    rows = [(f"d{i}", [rng.choice(["ab", "cd", "éé", "中文", "ef"]) for _ in range(rng.randint(0, 40))]) for i in range(30)]
    return [*rows, ("none", None), (None, ["ab", "cd"]), ("twice", ["ab", "ab", "ab"]), ("twice", ["ab", "ab", "ab"])]


def test_rows_are_counted_each_for_itself(spark):
    rows = _rows(spark)
    df = spark.createDataFrame(rows, "doc_id string, t array<string>").coalesce(1)
    for width, names in ((1, ("term", "tf")), (2, ("w1", "w2", "n"))):
        wanted = Counter(
            (i, *run, n) for i, t in rows if i is not None and t
            for run, n in Counter(zip(*[t[k:] for k in range(width)], strict=False)).items()
        )
        got = text_stats.counted_rows(df, F.col("t"), width, names)
        assert got.columns == ["doc_id", *names]
        assert Counter(map(tuple, got.collect())) == wanted


def test_small_parts_give_the_same_counts(spark, monkeypatch):
    df = spark.createDataFrame(_rows(spark), "doc_id string, t array<string>").coalesce(1)
    whole = Counter(map(tuple, text_stats.counted_rows(df, F.col("t"), 2, ("w1", "w2", "n")).collect()))
    monkeypatch.setattr(text_stats, "PART_BYTES", 64)
    assert Counter(map(tuple, text_stats.counted_rows(df, F.col("t"), 2, ("w1", "w2", "n")).collect())) == whole


def test_pairs_are_joined_by_one_number(spark):
    """Counts and pairs of the model are sorted by a number, not by two words; no pair is lost."""
    docs = spark.createDataFrame([(1, "aa bb aa bb cc"), (2, "bb aa cc cc cc")], "doc_id long, text string")
    counts = text_stats.pair_counts(docs)
    model = text_stats.PairModel.fit(docs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for whole in (True, False):
            found = model.scored(counts, whole=whole)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin [a1" in plan and "SortMergeJoin [w1#" not in plan.split("SortMergeJoin [a1")[1].split("\n")[0]
            assert found.count() == counts.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    both = [{(r.doc_id, r.n, round(r.lp, 12)) for r in model.scored(counts, whole=w).collect()} for w in (True, False)]
    assert both[0] == both[1]
