"""Reproducible random tests drawn per stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.hot_groups import ranked
from rankloom.session import written

# ---- fixed values: questions drawn per type ------------------------------
QUOTAS = {"subjective": 5, "objective": 8, "mcq": 8, "code": 4}
# ---- end of fixed values ------------------------------------------------


def draw_key(seed: str, key: str) -> Column:
    """Random but repeatable sort key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_test(
    questions: DataFrame,
    seed: str,
    strata=("category", "difficulty"),
    quotas: dict[str, int] | None = None,
    key: str = "question_id",
) -> DataFrame:
    """Per stratum and question type the quota of questions with the smallest keys.

    The constant bound lets each task drop all but its own best rows before the
    shuffle, so a stratum may be of any size.
    """
    quotas = quotas or QUOTAS
    window = Window.partitionBy(*strata, "question_type").orderBy(draw_key(seed, key), key)
    quota = F.lit(0)
    for kind, n in quotas.items():
        quota = F.when(F.col("question_type") == kind, n).otherwise(quota)
    return (
        questions.where(F.col("question_type").isin(*quotas))
        .withColumn("draw", F.row_number().over(window))
        .where(F.col("draw") <= max(quotas.values()))
        .where(F.col("draw") <= quota)
    )


def question_union(questions: DataFrame, seed: str, **kwargs) -> DataFrame:
    """The draws of all types together: one scan and one window make them."""
    return stratified_test(questions, seed, quotas=QUOTAS, **kwargs)


def random_number(key: Column, below: Column) -> Column:
    """A number from 0 up to ``below``, the same for the same key."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % below


def random_ranks(size: Column, quota: int, key: Column) -> Column:
    """``min(quota, size)`` different numbers below ``size`` in random order, the same
    for the same key, with as many draws: a number that is there already gives way
    to the highest one allowed, put behind it."""
    wanted = F.least(F.lit(quota).cast("long"), size)

    def drawn(chosen: Column, j: Column) -> Column:
        highest = size - wanted + j
        number = random_number(F.concat_ws(":", key, j.cast("string")), highest + 1)
        at = F.array_position(chosen, number).cast("int")
        return F.when(at > 0, F.array_insert(chosen, F.greatest(at, F.lit(0)) + 1, highest)).otherwise(F.array_prepend(chosen, number))

    draws = F.slice(F.sequence(F.lit(0).cast("long"), F.lit(quota - 1).cast("long")), F.lit(1), wanted.cast("int"))
    return F.aggregate(draws, F.array().cast("array<bigint>"), drawn)


def test_per_candidate(
    starts: DataFrame,
    questions: DataFrame,
    seed: str,
    candidate: str = "candidate_id",
    strata=("category", "difficulty"),
    quotas: dict[str, int] | None = None,
    key: str = "question_id",
) -> DataFrame:
    """A test of its own for every row of ``starts`` (``candidate`` and strata): per
    question type the quota, or all there are, drawn without repeats.

    The questions are ranked once within stratum and type. A start draws ranks, not
    questions, so the work is the questions drawn, and the join meets one row per
    rank: a stratum that most starts share is spread over its ranks. ``draw``
    is the place within the type. Starts whose stratum has no question get none.
    """
    quotas = quotas or QUOTAS
    group = [*strata, "question_type"]
    ordered = ranked(
        questions.where(F.col("question_type").isin(*quotas)), group,
        F.struct(draw_key(seed, key).alias("draw"), F.col(key).alias("key")),
    )
    ordered = written(ordered.withColumn("_rank", F.col("rank") - 1).drop("rank"), "ranked-questions")
    # One row per stratum, with the number of questions of each type.
    sizes = ordered.groupBy(*strata).agg(*[
        F.coalesce(F.max(F.when(F.col("question_type") == kind, F.col("group_rows"))), F.lit(0).cast("long")).alias(f"_{kind}")
        for kind in quotas
    ])
    sized = starts.select(candidate, *strata).join(sizes, list(strata))
    who = F.concat_ws(":", F.lit(seed), F.col(candidate).cast("string"))
    parts = F.array(*[
        F.struct(
            F.lit(kind).alias("question_type"),
            random_ranks(F.col(f"_{kind}"), quota, F.concat_ws(":", who, F.lit(kind))).alias("ranks"),
        )
        for kind, quota in quotas.items()
    ])
    drawn = sized.select(candidate, *strata, F.inline(parts)).select(
        candidate, *group, F.posexplode("ranks").alias("draw", "_rank")
    )
    return (
        drawn.join(ordered.drop("group_rows"), [*group, "_rank"])
        .withColumn("draw", F.col("draw") + 1)
        .drop("_rank")
    )


def distinct_rows(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.dropDuplicates(list(keys)) if keys else rows.distinct()
