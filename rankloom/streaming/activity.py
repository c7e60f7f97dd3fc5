"""Activity logs as a stream: the append-only table and the live flag counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.activity import FLAGS, flag_totals
from rankloom.session import new_table_path
from rankloom.streaming.runs import MERGED, Runs, summed


def activity_sink(stream: DataFrame, path: str, checkpoint: str):
    """Append each log record with the time it was taken in."""
    stamped = stream.withColumn("logged_at", F.current_timestamp())
    return (
        stamped.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def _ids(stream: DataFrame, path: str, merged: int) -> Runs:
    kind = stream.schema["event_id"].dataType.simpleString()
    return Runs(f"{path}/ids", f"event_id {kind}, day date", lambda rows: rows, "day", merged)


def _counts(kind: str, path: str, merged: int) -> Runs:
    names = [name for _, name in FLAGS]
    schema = ", ".join([f"candidate_id {kind}", *(f"{name} bigint" for name in names)])
    return Runs(f"{path}/counts", schema, summed("candidate_id", names), merged=merged)


def earlier_ids(ids: Runs, rows: DataFrame, batch_id: int) -> DataFrame:
    """The ids that earlier batches stored on the days that ``rows`` touch; no other
    day's folders are read."""
    days = [r.day for r in rows.select("day").distinct().collect()]
    known = [d for d in days if d is not None]
    touched = F.col("day").isin(known) if known else F.lit(False)
    if None in days:
        touched = touched | F.col("day").isNull()
    return ids.before(rows.sparkSession, batch_id).where(touched)


def activity_stream_counts(stream: DataFrame, path: str, checkpoint: str, merged: int = MERGED):
    """Flag counts per candidate, kept up to date; no record comes too late.

    An event is known by its id and the day of its time (``ts``), which a repeated
    record repeats. Each batch leaves out the events that earlier batches have stored,
    reading the ids of the days it touches only, and adds a run of ids and one of
    partial counts. Both are merged as they grow, see ``runs``; the stream itself
    holds no state. Events without an id are one event of their day.
    """
    candidate = stream.schema["candidate_id"].dataType.simpleString()
    ids, counts = _ids(stream, path, merged), _counts(candidate, path, merged)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", F.to_date("ts"))
        same = F.col("event_id").eqNullSafe(F.col("_id")) & F.col("day").eqNullSafe(F.col("_day"))
        earlier = earlier_ids(ids, rows, batch_id).toDF("_id", "_day")
        fresh = rows.dropDuplicates(["event_id", "day"]).join(earlier, same, "left_anti")
        # Written once and read back by both runs; the next batch takes its place.
        fresh.select("event_id", "day", "candidate_id", "flags").write.mode("overwrite").parquet(f"{path}/arrived")
        arrived = spark.read.parquet(f"{path}/arrived")
        ids.write(arrived.select("event_id", "day"), batch_id)
        counts.write(flag_totals(arrived), batch_id)
        ids.tidy(spark, batch_id)
        counts.tidy(spark, batch_id)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def current_counts(spark: SparkSession, path: str, candidate: str = "bigint", merged: int = MERGED) -> DataFrame:
    """The counts of every candidate: the sums of what the batches have written."""
    return _counts(candidate, path, merged).current(spark)


def stream_places(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh table and checkpoint paths in the shared folder."""
    return new_table_path(spark, name), new_table_path(spark, f"{name}-checkpoint")
