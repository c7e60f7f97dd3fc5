"""Rankings, joins and lifecycle on small tables, hot groups included."""

from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.operators import hot_groups, lifecycle, ranking, relations, sampling
from rankloom.plans.entities import Entities, now


@pytest.fixture(scope="module")
def skewed(spark, small):
    """A third of all applications to one job, many with one score."""
    apps = Entities(spark, small).applications()
    return apps.withColumns(
        {
            "job_id": F.when(F.col("app_id") % 3 == 0, 7).otherwise(F.col("job_id")),
            "score": F.when(F.col("app_id") % 5 == 0, 1.0).when(F.col("app_id") % 97 != 0, F.col("score")),
        }
    ).cache()


def test_ranks_equal_a_plain_window(skewed):
    order = ranking.by_score("score", "app_id")
    group = Window.partitionBy("job_id")
    plain = skewed.select(
        "app_id",
        F.row_number().over(group.orderBy(F.desc_nulls_last("score"), "app_id")).alias("r"),
        F.count("*").over(group).alias("n"),
    )
    both = hot_groups.ranked(skewed, ["job_id"], order).join(plain, "app_id")
    assert both.count() == skewed.count()
    assert both.where("rank <> r or group_rows <> n").count() == 0
    top = ranking.shortlist_top_fraction(skewed).join(plain, "app_id")
    assert top.where("rank <> r").count() == 0
    assert top.count() == plain.where("r <= greatest(1, floor(n * 0.2D))").count()


def test_group_of_nearly_all_rows_is_cut(spark):
    """One group holds nine rows of ten, and a null group is a group."""
    df = spark.range(4000).select(
        F.col("id").alias("app_id"), F.when(F.col("id") % 10 > 0, 7).when(F.col("id") % 20 > 0, 8).alias("job_id"),
        (F.col("id") * 7919 % 1000).cast("double").alias("score"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = hot_groups._in_order(df, ["job_id"], ranking.by_score("score", "app_id"))
        sizes = [r["count"] for r in rows.where("job_id = 7").groupBy("_part").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1500
        got = hot_groups.ranked(df, ["job_id"], ranking.by_score("score", "app_id"))
        group = Window.partitionBy("job_id")
        plain = df.select(
            "app_id", F.row_number().over(group.orderBy(F.desc("score"), "app_id")).alias("r"), F.count("*").over(group).alias("n")
        )
        assert got.join(plain, "app_id").where("rank = r and group_rows = n").count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_equals_range_join(spark, skewed):
    events = skewed.select(F.col("job_id").alias("user"), "applied_at", "app_id")
    versions = skewed.where("app_id % 7 = 1").select(
        F.col("job_id").alias("user"), F.col("applied_at").alias("version_ts"), F.col("app_id").alias("version")
    )
    got = relations.snapshot_asof(events, versions, "user", "applied_at", "app_id", "version_ts", "version")
    expected = (
        events.alias("e")
        .join(versions.alias("v"), F.expr("e.user = v.user and v.version_ts <= e.applied_at"), "left")
        .groupBy("app_id")
        .agg(F.max_by("version", F.struct("version_ts", "version")).alias("expected"))
    )
    both = got.join(expected, "app_id")
    assert both.count() == events.count()
    assert both.where("not (version <=> expected)").count() == 0


def test_numbers_are_not_ranked_as_text(spark):
    rows = [(1, 1, 9.5e-05), (2, 1, 0.8), (3, 1, -0.2), (4, 1, None), (5, 1, 0.8)]
    df = spark.createDataFrame(rows, "app_id bigint, job_id bigint, score double")
    out = hot_groups.ranked(df, ["job_id"], ranking.by_score("score", "app_id")).orderBy("rank")
    assert [r.app_id for r in out.collect()] == [2, 5, 1, 3, 4]


@pytest.mark.parametrize("n, kept", [(1, 1), (4, 1), (9, 1), (10, 2), (14, 2), (15, 3)])
def test_shortlist_size(spark, n, kept):
    df = spark.range(n).select(F.col("id").alias("app_id"), F.lit(1).alias("job_id"), F.rand(1).alias("score"))
    assert ranking.shortlist_top_fraction(df).count() == kept


def test_final_selection_options(spark):
    rows = [(1, 1, 1, 90.0, True, False), (2, 1, 1, 95.0, True, False), (3, 2, 1, 99.0, False, False),
            (4, 3, 1, 50.0, True, True)]
    df = spark.createDataFrame(
        rows, "candidate_id bigint, user_id bigint, job_id bigint, total_score double, test_taken boolean, final_email_sent boolean"
    )
    def ids(**kw):
        return [r.candidate_id for r in ranking.final_selection(df, fraction=1.0, **kw).orderBy("rank").collect()]
    assert ids() == [3, 2, 1]
    assert ids(require_taken=True) == [2, 1]
    assert ids(one_per_user=True) == [3, 2]


def test_closing_is_done_once(spark, small):
    e = Entities(spark, small)
    first, closed = lifecycle.close_due_jobs(e.jobs(), e.applications(), now())
    assert first.count() > 0
    again, closed_again = lifecycle.close_due_jobs(closed, e.applications(), now())
    assert again.count() == 0
    assert closed_again.exceptAll(closed).count() == 0


def test_final_tick_is_done_once(spark, small):
    e = Entities(spark, small)
    selected, flagged = lifecycle.final_select_tick(e.candidates(), now())
    assert selected.count() > 0
    again, _ = lifecycle.final_select_tick(flagged, now())
    assert again.count() == 0


def test_candidates_without_logs_stay(spark):
    cands = spark.createDataFrame([(1, "a"), (2, "b")], "candidate_id int, name string")
    logs = spark.createDataFrame([(1, 10), (1, 11)], "candidate_id int, event_id int")
    out = relations.candidate_logs(cands, logs).collect()
    assert sorted((r.candidate_id, r.name, r.event_id) for r in out if r.event_id) == [(1, "a", 10), (1, "a", 11)]
    assert [(r.candidate_id, r.event_id) for r in out if not r.event_id] == [(2, None)]


def test_apply_once(spark):
    schema = "app_id int, job_id int, seeker_id int, at int"
    old = spark.createDataFrame([(1, 1, 1, 0)], schema)
    new = spark.createDataFrame([(2, 1, 1, 1), (3, 1, 2, 5), (4, 1, 2, 4), (5, 2, 1, 1)], schema)
    out = relations.apply_once(old, new, ["job_id", "seeker_id"], F.struct("at", "app_id"))
    assert sorted(r.app_id for r in out.collect()) == [4, 5]


def test_weights_and_rejects(spark):
    answers = spark.createDataFrame([(1, 1), (2, 2), (3, 9)], "answer_id int, question_id int")
    questions = spark.createDataFrame([(1, "x", "mcq"), (2, "y", "mcq")], "question_id int, category string, question_type string")
    weights = spark.createDataFrame([("x", "mcq", 0.5)], "category string, question_type string, weight double")
    good, rejects = relations.answer_question_weight(answers, questions, weights)
    assert [(r.answer_id, r.weight) for r in good.collect()] == [(1, 0.5)]
    assert [r.answer_id for r in rejects.collect()] == [2]


def test_ttl_partitions_the_rows(spark):
    t = datetime(1998, 8, 1)
    df = spark.createDataFrame(
        [(1, t, 1, True), (2, t, 5, True), (3, t, 1, False), (4, None, 1, True)],
        "id int, created_at timestamp_ntz, deadline_days int, active boolean",
    )
    assert [r.id for r in lifecycle.ttl_expired(df, now()).collect()] == [1]
    assert sorted(r.id for r in lifecycle.ttl_kept(df, now()).collect()) == [2, 3, 4]


def test_draw_is_repeatable_and_within_quota(spark, small):
    questions = Entities(spark, small).questions()
    a = sampling.stratified_test(questions, "s1")
    assert a.exceptAll(sampling.stratified_test(questions, "s1")).count() == 0
    assert a.join(sampling.stratified_test(questions, "s2"), "question_id", "left_anti").count() > 0 or a.count() == questions.count()
    sizes = a.groupBy("category", "difficulty", "question_type").count().collect()
    assert all(r["count"] <= sampling.QUOTAS[r.question_type] for r in sizes)
    assert sampling.question_union(questions, "s1").exceptAll(a).count() == 0


def test_draw_prunes_before_the_shuffle(spark, small):
    plan = sampling.stratified_test(Entities(spark, small).questions(), "s1")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
