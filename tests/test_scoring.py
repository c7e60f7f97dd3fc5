"""Scores by hand: the quirks of each rule."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import categories as cat
from rankloom.operators import activity, scoring


@pytest.mark.parametrize(
    "given, correct, score",
    [(" a ", "A\n", 0.0125), ("b", "a", 0.0), ("", "a", 0.0), (None, "a", 0.0), ("a", "", 0.0), ("a", None, 0.0), (" ", " ", 0.0125)],
)
def test_choice(spark, given, correct, score):
    df = spark.createDataFrame([(given, correct)], "g string, c string")
    assert df.select(scoring.score_choice(F.col("g"), F.col("c"), F.lit(0.1))).first()[0] == pytest.approx(score)


@pytest.mark.parametrize("similarity, points", [(0.0999, 0.0), (0.1, 1.0), (0.51239, 5.12), (-0.5, 0.0), (None, 0.0)])
def test_subjective_points(spark, similarity, points):
    df = spark.createDataFrame([(similarity,)], "s double")
    assert df.select(scoring.subjective_points(F.col("s"))).first()[0] == pytest.approx(points)


RUNS = {
    1: [(1, "ok\n", "ok", None)],
    2: [(1, "no", "ok", None)],
    3: [(1, None, "ok", "timeout")],
    4: [(1, "no", "ok", None), (2, None, "ok", "timeout")],
    5: [(1, None, "ok", "timeout"), (2, "no", "ok", None)],
    6: [(1, "ok", "ok ", None)],
}


@pytest.mark.parametrize(
    "kw, passed",
    [
        ({}, {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}),
        ({"strict": True}, {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}),
        ({"trim_expected": True}, {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}),
    ],
)
def test_code(spark, kw, passed):
    rows = [(a, *r) for a, runs in RUNS.items() for r in runs]
    runs = spark.createDataFrame(rows, "answer_id int, case_no int, stdout string, expected string, error string")
    assert {r.answer_id: r.all_passed for r in scoring.code_results(runs, **kw).collect()} == passed


def test_answers_without_cases_pass(spark):
    df = spark.sql("SELECT CAST(NULL AS BOOLEAN) p")
    assert df.select(scoring.score_code(F.col("p"), F.lit(0.4))).first()[0] == pytest.approx(0.1)


def test_full_marks_are_one_hundred(spark):
    """All of a full test right, in every category."""
    counts = {"mcq": 8, "objective": 8, "subjective": 5, "code": 4}
    weights = cat.weights_dim(spark)
    rows = [(k, i) for k, n in counts.items() for i in range(n)]
    answers = weights.join(spark.createDataFrame(rows, "question_type string, i int"), "question_type").select(
        F.col("category").alias("candidate_id"), "question_type", "weight",
        F.lit("a").alias("value"), F.lit("A").alias("correct_answer"),
        F.array(F.lit(1.0), F.lit(2.0)).alias("reference_vector"),
        F.array(F.lit(2.0), F.lit(4.0)).alias("answer_vector"),
        F.lit(True).alias("all_passed"),
    )
    totals = scoring.candidate_total(scoring.answer_scores(answers)).collect()
    assert len(totals) == 7
    assert all(r.total_score == pytest.approx(100.0) for r in totals)


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        cat.weights_dim(spark, (("x", 0.5, 0.5, 0.5, 0.5),))


FLAG_ROWS = [
    ('{"tabSwitch": true}', 1), ('{"tabSwitch": 1}', 1), ('{"tabSwitch": 1.0}', 1), ('{"tabSwitch": "true"}', 0),
    ('{"tabSwitch": "1"}', 0), ('{"tabSwitch": 2}', 0), ('{"tabSwitch": false}', 0), ('{"tabSwitch": null}', 0),
    ('"{\\"tabSwitch\\": true}"', 1), ('"not json"', 0), ("{}", 0), ("", 0), (None, 0), ("[1]", 0), ("broken{", 0),
]


@pytest.mark.parametrize("i", range(len(FLAG_ROWS)))
def test_flag_forms(spark, i):
    flags, expected = FLAG_ROWS[i]
    cands = spark.createDataFrame([(1,), (2,)], "candidate_id int")
    logs = spark.createDataFrame([(1, flags)], "candidate_id int, flags string")
    out = {r.candidate_id: r for r in activity.flag_counts(cands, logs).collect()}
    assert out[1].tab_switch_count == expected
    assert out[2].tab_switch_count == 0 and out[1].copy_attempted == 0


@pytest.mark.parametrize(
    "label, expected",
    [
        ("Cybersecurity", "Cybersecurity"), ("cybersecurity", "Cybersecurity"), ("mobile", "Mobile Development"),
        ("It is QA / Test Engineering.", "QA / Test Engineering"), ("", "AI / Machine Learning"),
        ("development", "Backend Development"), ("gardening", "gardening"), (None, None),
    ],
)
def test_title_category(spark, label, expected):
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(cat.title_category(F.col("l"))).first()[0] == expected


def test_buckets_and_decode(spark):
    df = spark.createDataFrame([(0, "basic"), (2, "basic"), (3, "intermediate"), (5, "intermediate"), (6, "hard")], "y int, e string")
    assert all(r.e == r.b for r in df.select("e", cat.experience_bucket(F.col("y")).alias("b")).collect())
    assert spark.range(7).select(cat.label_decode(F.col("id")).alias("n")).distinct().count() == 7
    with pytest.raises(Exception, match="unknown category number 7"):
        spark.range(7, 8).select(cat.label_decode(F.col("id"))).collect()


def test_composite_weights_per_role(spark):
    cols = "job int, key int, role string, resume_match double, objective double, subjective double, aptitude double, programming double"
    parts = spark.createDataFrame([(1, 1, "r", 1.0, 1.0, 1.0, 1.0, 1.0), (1, 2, "s", 0.0, 0.0, 0.0, 0.0, 2.0)], cols)
    plain = {r.key: r.final_score for r in scoring.composite_rank(parts, "job", "key").collect()}
    assert plain == {1: pytest.approx(1.0), 2: pytest.approx(0.3)}
    weights = spark.createDataFrame([("s", "programming", 0.9)], "role string, part string, weight double")
    tuned = {r.key: (r["rank"], r.final_score) for r in scoring.composite_rank(parts, "job", "key", weights).collect()}
    assert tuned == {2: (1, pytest.approx(1.8)), 1: (2, pytest.approx(1.0))}
