"""Tables written back by the scoring jobs. Every write makes a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ml import embed, hashed_encoder
from rankloom.session import written


def vector_backfill(questions: DataFrame, encoder=hashed_encoder) -> DataFrame:
    """All questions with the vector of the reference answer recomputed for the
    subjective ones; a missing answer counts as empty."""
    if "reference_vector" not in questions.columns:
        questions = questions.withColumn("reference_vector", F.lit(None).cast("array<float>"))
    # Only what is written down anew is encoded.
    wanted = F.coalesce(F.col("question_type") == "subjective", F.lit(False))
    answers = questions.where(wanted).withColumn("_answer", F.coalesce("reference_answer", F.lit("")))
    coded = embed(answers, "_answer", "_vector", encoder).withColumn("reference_vector", F.col("_vector"))
    return written(questions.where(~wanted).union(coded.select(*questions.columns)), "questions")


def score_writeback(rows: DataFrame, scores: DataFrame, key: str, column: str = "score") -> DataFrame:
    """A new version of ``rows`` with the new scores where there are any."""
    new = scores.select(key, F.col(column).alias("_new"))
    merged = rows.join(new, key, "left").withColumn(column, F.coalesce("_new", F.col(column)))
    return written(merged.select(*rows.columns), "scores")
