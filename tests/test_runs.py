"""Tables in merged runs, and the streams that write them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators.activity import FLAGS
from rankloom.streaming import activity, applications, runs


@pytest.mark.parametrize("merged", [2, 3, 8])
def test_runs_hold_every_batch_once(merged):
    for batches in range(200):
        held = []
        for level, number in runs.holding(batches, merged):
            held += range(number * merged**level, (number + 1) * merged**level)
        assert held == list(range(batches))


def test_merges_make_what_readers_ask_for():
    there = set()
    for batch in range(100):
        assert set(runs.holding(batch, 3)) <= there
        there.add((0, batch))
        for level, number in runs.due_after(batch, 3):
            parts = {(level - 1, number * 3 + i) for i in range(3)}
            assert parts <= there
            there.add((level, number))
        for level, number in runs.due_after(batch - 1, 3) if batch else []:
            there -= {(level - 1, number * 3 + i) for i in range(3)}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = runs.Runs(f"file://{tmp_path}/t", "k bigint, n bigint", runs.summed("k", ["n"]), merged=2)
    for batch in (0, 1, 1, 2, 3, 3, 3, 4):
        table.write(spark.createDataFrame([(batch % 3, 1)], "k bigint, n bigint"), batch)
        table.tidy(spark, batch)
    assert sorted(map(tuple, table.current(spark).collect())) == [(0, 2), (1, 2), (2, 1)]
    assert runs.written_batches(spark, table.root, 2) == 5
    assert runs.written_batches(spark, f"file://{tmp_path}/none", 2) == 0


def test_fifty_batches_of_late_and_repeated_records(spark, tmp_path, monkeypatch):
    """Counts are whole, and a batch reads the ids of its own days only."""
    rng = random.Random(1)
    day = dt.datetime(2024, 1, 1)
    events = [
        (i, i % 7, '{"tabSwitch": true}', False, day + dt.timedelta(days=(i // 8 if i % 5 else rng.randint(0, 49)), hours=i % 24))
        for i in range(400)
    ]
    schema = "event_id bigint, candidate_id bigint, flags string, suspicious boolean, ts timestamp"
    source = f"{tmp_path}/in"
    for batch in range(50):
        rows = events[8 * batch : 8 * batch + 8] + rng.sample(events[: 8 * batch + 8], 3)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    read, day_names = [], [f"day={(day + dt.timedelta(days=i)).date()}" for i in range(51)]
    plain = activity.earlier_ids

    def watched(ids, rows, batch_id):
        out = plain(ids, rows, batch_id)
        days = {f"day={r.day}" for r in rows.select("day").distinct().collect()}
        scans = out._jdf.queryExecution().executedPlan().collectLeaves()
        for i in range(scans.size()):
            if scans.apply(i).nodeName().startswith("Scan parquet"):
                scanned = scans.apply(i).selectedPartitions().toString()
                assert {p for p in day_names if p in scanned} <= days
        read.append(len(runs.holding(batch_id, 4)))
        return out

    monkeypatch.setattr(activity, "earlier_ids", watched)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    activity.activity_stream_counts(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/c", merged=4).awaitTermination()
    got = {r.candidate_id: r.tab_switch_count for r in activity.current_counts(spark, f"file://{tmp_path}/t", merged=4).collect()}
    assert got == {k: sum(1 for e in events if e[1] == k) for k in range(7)}
    assert len(read) == 50 and max(read) <= 9  # at most three runs on each of three levels
    assert FLAGS[2][1] == "tab_switch_count"


def test_newest_keeps_one_row_per_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y"), ("a", 2, "w")], "owner string, v int, t string")
    got = runs.newest("owner", "v")(rows).collect()
    assert sorted((r.owner, r.v, r.t) for r in got) == [("a", 3, "z"), ("b", 2, "y")]


def test_resumes_in_any_order(spark, tmp_path, monkeypatch):
    """Old versions after new ones, and a file twice: the newest stays, once prepared."""
    made = []

    def prepared(versions, phrases, model, encoder):
        made.extend(r.doc_id for r in versions.collect())
        return versions.withColumns({
            "vectors": F.array(F.array(F.lit(1.0).cast("float"))), "category": F.lit("c"), "skills": F.array(F.lit("s")),
        })

    monkeypatch.setattr(applications, "prepared", prepared)
    source, schema = f"{tmp_path}/in", "owner string, doc_id bigint, text string"
    batches = [[("a", 5, "new")], [("a", 1, "old"), ("b", 2, "b2")], [("b", 4, "b4"), ("b", 3, "b3")], [("a", 5, "new")], [("c", 1, "c1")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = f"file://{tmp_path}/t"
    applications.resume_update_stream(stream, None, None, path, f"file://{tmp_path}/c", merged=2).awaitTermination()
    got = applications.resumes(path, merged=2).current(spark).collect()
    assert sorted((r.owner, r.doc_id, r.text) for r in got) == [("a", 5, "new"), ("b", 4, "b4"), ("c", 1, "c1")]
    assert sorted(made) == [1, 2, 4, 5]  # neither a's first version nor its newest once more
