"""Rankings, top fractions and counts per job.

Scores are compared as numbers, and the key breaks ties, so every ranking is
total. Ranking inside a job goes through ``hot_groups``: no job is too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.hot_groups import ranked
from rankloom.session import settled

TOP_FRACTION = 0.2  # fixed value
TOP_JOBS = 3  # fixed value


def by_score(score: str, key: str) -> Column:
    """Sort key: highest score first, missing scores last, then the key."""
    value = F.col(score)
    return F.struct(value.isNull().alias("none"), (-value).alias("score"), F.col(key).alias("key"))


def application_count(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """Applications per job, 0 for jobs without any."""
    counts = applications.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    return jobs.join(counts, "job_id", "left").withColumn(
        "application_count", F.coalesce("n", F.lit(0).cast("long"))
    ).drop("n")


def top_jobs_by_count(jobs: DataFrame, applications: DataFrame, n: int = TOP_JOBS) -> DataFrame:
    counted = application_count(jobs, applications)
    return counted.orderBy(F.desc("application_count"), "job_id").limit(n)


def top_jobs_by_date(jobs: DataFrame, n: int = TOP_JOBS) -> DataFrame:
    return jobs.orderBy(F.desc("posted_at"), "job_id").limit(n)


def top_fraction(
    rows: DataFrame,
    group: str,
    score: str,
    key: str,
    fraction: float = TOP_FRACTION,
) -> DataFrame:
    """The first ``max(1, int(n * fraction))`` rows of each group by score."""
    def quota(n: Column) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.floor(n * F.lit(float(fraction))))

    return ranked(rows, [group], by_score(score, key), keep=quota)


def shortlist_top_fraction(
    applications: DataFrame, fraction: float = TOP_FRACTION
) -> DataFrame:
    return top_fraction(applications, "job_id", "score", "app_id", fraction)


def final_selection(
    candidates: DataFrame,
    fraction: float = TOP_FRACTION,
    require_taken: bool = False,
    one_per_user: bool = False,
) -> DataFrame:
    """Best candidates of each job among those without a final message.

    By default every such row counts, also tests not taken and repeated starts;
    ``require_taken`` and ``one_per_user`` leave those out.
    """
    open_rows = candidates.where(~F.col("final_email_sent"))
    if require_taken:
        open_rows = open_rows.where("test_taken")
    if one_per_user:
        best = F.struct(F.coalesce("total_score", F.lit(float("-inf"))), -F.col("candidate_id"))
        open_rows = (
            open_rows.groupBy("user_id", "job_id")
            .agg(F.max_by(F.struct(*candidates.columns), best).alias("_best"))
            .select("_best.*")
        )
    return top_fraction(open_rows, "job_id", "total_score", "candidate_id", fraction)


def document_flags(stuffing: DataFrame, generated: DataFrame, skills: DataFrame) -> DataFrame:
    """One narrow row per document, made when a version of it arrives and stored:
    rankings need nothing else of its text."""
    return (
        stuffing.select("doc_id", "is_suspicious")
        .join(generated.select("doc_id", "is_suspicious_ai"), "doc_id", "full")
        .join(skills.select("doc_id", "skills"), "doc_id", "full")
    )


def job_ranking(applications: DataFrame, flags: DataFrame) -> DataFrame:
    """All applications ranked within their job, with the suspicion flags and
    skills of the resume (``doc_id``). Texts without a flag are not suspicious."""
    # Stored: what ranking takes on disk is gone when the flags are joined.
    order = settled(lambda: ranked(applications, ["job_id"], by_score("score", "app_id")), "ranked", compression="zstd")
    return (
        order.join(flags, "doc_id", "left")
        .withColumns(
            {
                "is_suspicious": F.coalesce("is_suspicious", F.lit(False)),
                "is_suspicious_ai": F.coalesce("is_suspicious_ai", F.lit(False)),
                "skills": F.coalesce("skills", F.array().cast("array<string>")),
            }
        )
    )
