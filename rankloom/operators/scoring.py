"""Answer scores, candidate totals and the composite ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.cleaning import py_strip
from rankloom.functions.vectors import cosine
from rankloom.operators.hot_groups import ranked
from rankloom.operators.ranking import by_score

# ---- fixed values -------------------------------------------------------
CHOICE_QUESTIONS = 8
SUBJECTIVE_POINTS = 50
CODE_POINTS = 40
CODE_PASS = 10
LEAST_SIMILARITY = 0.1
TOTAL_SCALE = 100
COMPOSITE_WEIGHTS = (
    ("resume_match", 0.30),
    ("objective", 0.20),
    ("subjective", 0.20),
    ("aptitude", 0.15),
    ("programming", 0.15),
)
# ---- end of fixed values ------------------------------------------------


def score_choice(given: Column, correct: Column, weight: Column, out_of: int = CHOICE_QUESTIONS) -> Column:
    right = (correct != "") & (given != "") & (
        F.upper(py_strip(given)) == F.upper(py_strip(correct))
    )
    return weight * (F.when(right, 1.0).otherwise(0.0) / F.lit(out_of))


def subjective_points(similarity: Column) -> Column:
    kept = F.when(similarity < LEAST_SIMILARITY, 0.0).otherwise(similarity)
    return F.coalesce(F.round(kept * 10, 2), F.lit(0.0))


def score_similarity(similarity: Column, weight: Column, out_of: int = SUBJECTIVE_POINTS) -> Column:
    return weight * (subjective_points(similarity) / F.lit(out_of))


def score_subjective(
    reference: Column, answer: Column, weight: Column, out_of: int = SUBJECTIVE_POINTS
) -> Column:
    return score_similarity(cosine(reference, answer), weight, out_of)


def evidence(
    answers: DataFrame, vectors: DataFrame, results: DataFrame,
    reference: str = "r_id", answer: str = "g_id", vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``answers`` with what the score of their kind needs: ``similarity`` of the two
    vectors that ``reference`` and ``answer`` name, and ``all_passed`` (``results``).

    As in joins with ``vectors`` and ``results``, only answers with both vectors are kept,
    once for each that bears the name. But a vector is fetched for subjective answers
    alone, once for each pair of names, and no vector travels with an answer: the rest
    meet the names only. ``answers`` is read several times; store it first.
    """
    kind = F.coalesce("question_type", F.lit(""))
    names = vectors.select(F.col(vec_id).alias("_name"))

    def fetched(name: str, to: str) -> DataFrame:
        return vectors.select(F.col(vec_id).alias(name), F.col(vector).alias(to))

    written_ones = answers.where(kind == "subjective")
    compared = (
        written_ones.select(reference, answer).distinct()
        .join(fetched(reference, "_a"), reference)
        .join(fetched(answer, "_b"), answer)
        .select(reference, answer, cosine(F.col("_a"), F.col("_b")).alias("similarity"))
    )
    others = answers.where(kind != "subjective")
    for side in (reference, answer):
        others = others.join(names, F.col(side) == F.col("_name")).drop("_name")
    code = others.where(kind == "code").join(results, "answer_id", "left")
    return (
        written_ones.join(compared, [reference, answer])
        .unionByName(code, allowMissingColumns=True)
        .unionByName(others.where(kind != "code"), allowMissingColumns=True)
    )


def code_results(runs: DataFrame, strict: bool = False, trim_expected: bool = False) -> DataFrame:
    """Per answer whether its test runs pass.

    A run that ended in an error stops the checking, so only mismatches before
    the first error count; with ``strict`` an error fails the answer.
    """
    expected = py_strip(F.col("expected")) if trim_expected else F.col("expected")
    failed = F.col("error").isNotNull()
    differs = ~failed & (py_strip(F.col("stdout")) != expected)
    firsts = runs.groupBy("answer_id").agg(
        F.min(F.when(failed, F.col("case_no"))).alias("error_at"),
        F.min(F.when(differs, F.col("case_no"))).alias("mismatch_at"),
    )
    passed = F.col("mismatch_at").isNull()
    if strict:
        passed = passed & F.col("error_at").isNull()
    else:
        passed = passed | F.coalesce(F.col("mismatch_at") > F.col("error_at"), F.lit(False))
    return firsts.select("answer_id", passed.alias("all_passed"))


def score_code(all_passed: Column, weight: Column, out_of: int = CODE_POINTS) -> Column:
    """Answers without test cases pass."""
    passed = F.coalesce(all_passed, F.lit(True))
    return weight * (F.when(passed, float(CODE_PASS)).otherwise(0.0) / F.lit(out_of))


def answer_scores(answers: DataFrame) -> DataFrame:
    """Route and score each answer by its question's type.

    Needs ``question_type, value, correct_answer, all_passed, weight`` and either
    ``reference_vector, answer_vector`` or their ``similarity``.
    """
    if "similarity" in answers.columns:
        similarity = F.col("similarity")
    else:
        similarity = cosine(F.col("reference_vector"), F.col("answer_vector"))
    kind, value, weight = F.col("question_type"), F.col("value"), F.col("weight")
    choice = kind.isin("mcq", "objective")
    score = (
        F.when(choice, score_choice(value, F.col("correct_answer"), weight))
        .when(
            kind == "subjective",
            score_similarity(similarity, weight),
        )
        .when(kind == "code", score_code(F.col("all_passed"), weight))
    )
    return answers.withColumns(
        {
            "selected_option": F.when(choice, value),
            "written_answer": F.when(~choice, value),
            "score": score,
        }
    )


def candidate_total(scores: DataFrame) -> DataFrame:
    return scores.groupBy("candidate_id").agg(
        (F.sum("score") * TOTAL_SCALE).alias("total_score")
    )


def composite_rank(
    parts: DataFrame,
    group: str,
    key: str,
    role_weights: DataFrame | None = None,
    role: str = "role",
) -> DataFrame:
    """Weighted sum of the partial scores, ranked within the group.

    ``role_weights`` (``role, part, weight``; one row per role and part) adjusts
    the weights per role; a pair it lacks keeps the default weight.
    """
    if role_weights is not None:
        names = [name for name, _ in COMPOSITE_WEIGHTS]
        wide = role_weights.groupBy(role).pivot("part", names).agg(F.first("weight"))
        wide = wide.select(role, *[F.col(n).alias(f"_w_{n}") for n in names])
        parts = parts.join(wide, role, "left")
    total = F.lit(0.0)
    for name, default in COMPOSITE_WEIGHTS:
        weight = F.lit(default)
        if role_weights is not None:
            weight = F.coalesce(F.col(f"_w_{name}"), weight)
        total = total + weight * F.coalesce(F.col(name), F.lit(0.0))
    scored = parts.withColumn("final_score", total).drop(*[f"_w_{n}" for n, _ in COMPOSITE_WEIGHTS])
    return ranked(scored, [group], by_score("final_score", key))
