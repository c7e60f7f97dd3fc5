"""Ticks that handle every key once, however often they run.

Each tick writes what it did to folders of its own: first the outcome, then the
keys it handled. A tick leaves out the keys of earlier ticks, a repeated one
overwrites its own folders, and an outcome counts only together with its keys, so a
tick that broke off between the two leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Before any tick: an empty table, so that the first tick finds one to read.
NO_TICK = "0000"


def handled_once(
    due: DataFrame, key: str, path: str, tick: str, outcome: Callable[[DataFrame], DataFrame]
) -> None:
    """Write ``outcome`` of the due keys that no earlier tick has handled. ``tick``
    names the tick; names ascend (a date or time in ISO form)."""
    spark = due.sparkSession
    none = spark.createDataFrame([], due.select(key).schema)
    none.write.mode("overwrite").parquet(f"{path}/handled/tick={NO_TICK}")
    earlier = _ticks(spark, f"{path}/handled", f"{key} {due.schema[key].dataType.simpleString()}").where(F.col("tick") < tick)
    # Written once and read back by both; the next tick takes its place.
    due.select(key).distinct().join(earlier, key, "left_anti").write.mode("overwrite").parquet(f"{path}/fresh")
    fresh = spark.read.schema(none.schema).parquet(f"{path}/fresh")
    outcome(fresh).write.mode("overwrite").parquet(f"{path}/outcome/tick={tick}")
    fresh.write.mode("overwrite").parquet(f"{path}/handled/tick={tick}")


def outcomes(spark: SparkSession, key: str, path: str) -> DataFrame:
    """What all ticks have written, each key's rows by the tick that handled it."""
    rows = _ticks(spark, f"{path}/outcome")
    handled = _ticks(spark, f"{path}/handled", f"{key} {rows.schema[key].dataType.simpleString()}")
    return rows.join(handled, [key, "tick"], "left_semi")


def _ticks(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    # The schema names the tick as text, lest it is read as a date.
    if schema is None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema if f.name != "tick")
    return spark.read.schema(f"{schema}, tick string").parquet(path)
