"""Vectors that do not travel with every answer."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import scoring


@pytest.mark.parametrize("copies", [1, 2])
def test_evidence_equals_plain_joins(spark, copies):
    vectors = spark.range(6).select(
        F.when(F.col("id") != 5, F.col("id")).alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(2.0).cast("float")).alias("embedding")
    )
    for _ in range(copies - 1):
        vectors = vectors.union(vectors.where("vec_id = 2"))
    kinds = F.array(*map(F.lit, ("subjective", "code", "mcq", "objective")), F.lit(None).cast("string"))
    answers = spark.range(80).select(
        F.col("id").alias("candidate_id"), (F.col("id") % 9).alias("answer_id"), F.get(kinds, (F.col("id") % 5).cast("int")).alias("question_type"),
        F.lit("a").alias("value"), F.lit("A").alias("correct_answer"), F.lit(0.5).alias("weight"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 7).alias("r_id"), (F.col("id") % 5).alias("g_id"),
    )
    results = spark.range(4).select(F.col("id").alias("answer_id"), (F.col("id") % 2 == 0).alias("all_passed"))
    plain = (
        answers.join(vectors.select(F.col("vec_id").alias("r_id"), F.col("embedding").alias("reference_vector")), "r_id")
        .join(vectors.select(F.col("vec_id").alias("g_id"), F.col("embedding").alias("answer_vector")), "g_id")
        .join(results, "answer_id", "left")
    )
    columns = ["candidate_id", "selected_option", "written_answer", "score"]
    want, got = (
        sorted(map(str, scoring.answer_scores(rows).select(*columns).collect()))
        for rows in (plain, scoring.evidence(answers, vectors, results))
    )
    assert got == want and len(want) > 40
