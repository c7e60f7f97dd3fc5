"""Deadlines, pools and invitations: filters and the two closing ticks.

``now`` is always a parameter, so a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import final_selection, shortlist_top_fraction

# ---- fixed values: wording of the messages ------------------------------
INVITE_REASON = "You have been selected to take a test for the job"
INVITE_SUBJECT = "Test Invitation for %s"
INVITE_MESSAGE = "Dear %s,\n\n%s: %s.\n\nLink: %s"
FINAL_SUBJECT = "Final Selection – %s"
FINAL_MESSAGE = "Dear %s,\n\nYou have been selected in the final list for the position: %s.\n\nCongratulations.\n"
# ---- end of fixed values ------------------------------------------------

FINAL_DEADLINE_DAYS = 7  # fixed value


def jobs_due(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("deadline") <= now) & ~F.col("email_sent") & F.col("active"))


def candidates_due(candidates: DataFrame, now: Column) -> DataFrame:
    return candidates.where((F.col("final_deadline_date") <= now) & ~F.col("final_email_sent"))


def _expiry() -> Column:
    return F.col("created_at") + F.make_dt_interval(days=F.col("deadline_days").cast("int"))


def ttl_expired(rows: DataFrame, now: Column) -> DataFrame:
    """Active rows whose days to live are over."""
    return rows.where(F.col("active") & (_expiry() <= now))


def ttl_kept(rows: DataFrame, now: Column) -> DataFrame:
    """What a purge of the expired rows leaves."""
    return rows.where(~F.coalesce(F.col("active") & (_expiry() <= now), F.lit(False)))


def question_pool(
    questions: DataFrame, category: str, difficulty: str, question_type: str | None = None
) -> DataFrame:
    pool = questions.where((F.col("category") == category) & (F.col("difficulty") == difficulty))
    return pool if question_type is None else pool.where(F.col("question_type") == question_type)


def has_vectors(rows: DataFrame, column: str = "vectors") -> DataFrame:
    """Rows whose vector list is neither null nor empty."""
    return rows.where(F.size(F.coalesce(F.col(column), F.array().cast(rows.schema[column].dataType))) > 0)


def rows_by_owner(rows: DataFrame, owner_column: str, owner) -> DataFrame:
    return rows.where(F.col(owner_column) == owner)


def final_deadline(deadline: Column) -> Column:
    return deadline + F.make_dt_interval(days=F.lit(FINAL_DEADLINE_DAYS))


def invite_rows(
    selected: DataFrame, jobs: DataFrame, users: DataFrame, link_base: str,
    reason: str = INVITE_REASON,
) -> DataFrame:
    """One message per selected application (``job_id``, ``user_id``). To write
    to every applicant, pass all applications and a reason to match."""
    link = F.format_string("%s/%s/%s", F.lit(link_base), F.col("user_id"), F.col("job_id"))
    return (
        selected.join(jobs.select("job_id", "job_title"), "job_id")
        .join(users.select("user_id", "username", "email"), "user_id")
        .select(
            *[c for c in selected.columns if c not in ("job_id", "user_id")],
            "job_id",
            "user_id",
            F.col("email").alias("recipient"),
            F.format_string(INVITE_SUBJECT, F.col("job_title")).alias("subject"),
            F.format_string(
                INVITE_MESSAGE,
                F.col("username"), F.lit(reason), F.col("job_title"), link,
            ).alias("message"),
        )
    )


def final_rows(selected: DataFrame, jobs: DataFrame, users: DataFrame) -> DataFrame:
    """One message per finally selected candidate (``job_id``, ``user_id``)."""
    return (
        selected.join(jobs.select("job_id", "job_title"), "job_id")
        .join(users.select("user_id", "username", "email"), "user_id")
        .select(
            "candidate_id",
            "job_id",
            F.col("email").alias("recipient"),
            F.format_string(FINAL_SUBJECT, F.col("job_title")).alias("subject"),
            F.format_string(FINAL_MESSAGE, F.col("username"), F.col("job_title")).alias("message"),
        )
    )


def close_due_jobs(
    jobs: DataFrame, applications: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """One tick: the shortlist of every due job, and the jobs afterwards, with
    the due ones closed so that the next tick leaves them alone."""
    due = jobs_due(jobs, now).select("job_id")
    shortlist = shortlist_top_fraction(applications.join(due, "job_id", "left_semi"))
    is_due = (F.col("deadline") <= now) & ~F.col("email_sent") & F.col("active")
    is_due = F.coalesce(is_due, F.lit(False))
    closed = jobs.withColumns(
        {"email_sent": F.col("email_sent") | is_due, "active": F.col("active") & ~is_due}
    )
    return shortlist, closed


def jobs_with_due(candidates: DataFrame, now: Column) -> DataFrame:
    return candidates_due(candidates, now).select("job_id").distinct()


def final_select_tick(
    candidates: DataFrame, now: Column, require_taken: bool = False
) -> tuple[DataFrame, DataFrame]:
    """One tick: the final selection of every job with a due candidate, and the
    candidates afterwards, with all unsent ones of those jobs flagged."""
    jobs = jobs_with_due(candidates, now)
    selected = final_selection(
        candidates.join(jobs, "job_id", "left_semi"), require_taken=require_taken
    )
    flagged = (
        candidates.join(jobs.withColumn("_due", F.lit(True)), "job_id", "left")
        .withColumn("final_email_sent", F.col("final_email_sent") | F.coalesce("_due", F.lit(False)))
        .drop("_due")
    )
    return selected, flagged.select(*candidates.columns)
