"""Arriving files that no single task makes."""

import glob

from pyspark.sql import functions as F

from rankloom.plans.entities import Entities
from rankloom.plans.registry import QUERIES


def test_a_portion_is_several_files(spark, small):
    """No single task reads or writes all versions of a portion."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/versions-*"))
    assert QUERIES["resume_update_stream"](spark, small).count() > 0
    (made,) = set(glob.glob(f"{folder}/versions-*")) - before
    assert len(glob.glob(f"{made}/*.parquet")) > 4


def test_descriptions_are_made_in_several_tasks(spark, tmp_path):
    """Parts that lie in one row group make their texts in more than one task."""
    tables = {
        "part": (64, ["id AS p_partkey", "concat('green part ', id) AS p_name", "'SMALL TIN' AS p_type", "cast(id % 9 AS int) AS p_size", "900.5D AS p_retailprice"]),
        "benchmark": (3, ["id AS item_id", "concat('Prose of item ', id) AS text"]),
        "nation": (25, ["cast(id AS int) AS n_nationkey", "'PERU' AS n_name"]),
    }
    for name, (size, columns) in tables.items():
        spark.range(size).coalesce(1).selectExpr(*columns).write.parquet(f"{tmp_path}/{name}.parquet")
    texts = Entities(spark, str(tmp_path)).job_texts().withColumn("task", F.spark_partition_id())
    rows = texts.collect()
    assert sorted(r.job_id for r in rows) == list(range(64)) and all(r.text for r in rows)
    assert len({r.task for r in rows}) > 1
