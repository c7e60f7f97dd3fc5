"""Vector lists that do not travel with every application."""

from pyspark.sql import functions as F

from rankloom.functions.vectors import best_chunks
from rankloom.operators import matching


def test_cells_equal_plain_joins(spark):
    """Also with names that are null, missing or repeated, and in several slices."""
    lists = spark.range(30).select(
        F.when(F.col("id") == 29, 28).when(F.col("id") == 27, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.transform(F.sequence(F.lit(0), F.col("id") % 3), lambda i: F.array((i + 1).cast("float"), (F.col("id") - 9).cast("float"))).alias("vectors"),
    )
    apps = spark.range(600).select(
        F.col("id").alias("app_id"), (F.col("id") * 7 % 33).alias("resume_id"),
        F.when(F.col("id") % 50 != 0, F.col("id") % 31).alias("jd_id"), F.lit("kept").alias("n"),
    )
    plain = (
        apps.join(lists.select(F.col("doc_id").alias("resume_id"), F.col("vectors").alias("o")), "resume_id", "left")
        .join(lists.select(F.col("doc_id").alias("jd_id"), F.col("vectors").alias("w")), "jd_id", "left")
        .select("app_id", "n", best_chunks("w", "o").alias("b"), F.size("o").alias("m"))
    )
    want = sorted(plain.select("app_id", "n", F.to_json(F.struct("b", "m")).alias("x")).collect())
    for size in (matching.SLICE, 5):
        before, matching.SLICE = matching.SLICE, size
        try:
            got = matching._matched(apps, lists, lists).select("app_id", "n", F.to_json(F.struct(F.col("_best").alias("b"), F.col("_n").cast("int").alias("m"))).alias("x"))
            assert sorted(got.collect()) == want
        finally:
            matching.SLICE = before


def test_lists_go_to_cells_once(spark):
    """64 applications a job and resume, but 8 blocks: fewer lists are sent than there are applications."""
    lists = spark.range(16).select(F.col("id").alias("doc_id"), F.array(F.array(F.lit(1.0).cast("float"))).alias("vectors"))
    apps = spark.range(4096).select(F.col("id").alias("app_id"), (F.col("id") % 16).alias("resume_id"), F.floor(F.col("id") / 256).alias("jd_id"))
    plan = matching.chunk_maxsim(apps, lists, lists)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("MapInArrow")
    assert len(above) == 2 and "Join" not in above[0]
