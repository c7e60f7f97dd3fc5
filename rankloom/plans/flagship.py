"""Applications matched, ranked and shortlisted in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.matching import chunk_maxsim
from rankloom.operators.ranking import shortlist_top_fraction
from rankloom.plans.entities import Entities
from rankloom.session import written


def shortlist_by_match(e: Entities) -> DataFrame:
    """Scores are written back before they are ranked, so that counting a job's
    applications does not compute them a second time."""
    docs = e.vector_documents()
    scored = chunk_maxsim(e.vector_applications(), docs, docs)
    top = shortlist_top_fraction(written(scored.select("app_id", "job_id", "score"), "match-scores"))
    return top.select("job_id", "rank", "app_id", F.round("score", 6).alias("score"), "group_rows")
