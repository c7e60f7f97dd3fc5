"""Ordered work inside groups of any size.

A window over a group puts the whole group into one task. Here the rows are
exchanged by ranges of group and order, so that a large group is spread over as
many partitions as its share of the rows asks for, and stored in that order. What
must cross a partition's edge (rank offsets, the value carried forward) comes from
one small row for each group and partition. There is one plan for every size, and
nothing is counted or collected while it is made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import written


def _in_order(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``df`` stored by range, with the place ``_at`` of a row and its partition. The order
    is made on both sides of the exchange, and neither exchanged nor stored."""
    ordered = df.repartitionByRange(*keys, order).withColumn("_order", order)
    placed = ordered.sortWithinPartitions(*keys, "_order").withColumn("_at", F.monotonically_increasing_id())
    return written(placed.withColumn("_part", F.shiftright("_at", 33)).drop("_order"), "ordered", compression="zstd")


def _earlier(keys: list[str]):
    """The partitions of a group before the row's own: at most as many as there are."""
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _with_edges(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Join on group (null is one too) and partition."""
    names = {k: f"_edge_{i}" for i, k in enumerate([*keys, "_part"])}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(edges.withColumnsRenamed(names), same, "left").drop(*names.values())


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add ``rank`` (1, 2, ... in ``order`` within the group) and ``group_rows``.

    ``order`` is a struct sorted ascending, unique within the group. ``keep``
    maps the group's row count to the highest rank wanted.
    """
    keys = list(keys)
    rows = _in_order(df, keys, order)
    edges = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    edges = edges.withColumn("_before", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)))
    edges = edges.withColumn("group_rows", F.sum("_n").over(Window.partitionBy(*keys))).drop("_n")
    out = _with_edges(rows, edges, keys).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first") + 1)
    if keep is not None:
        out = out.where(F.col("rank") <= keep(F.col("group_rows")))
    return out.select(*df.columns, "rank", "group_rows")


def carried_forward(df: DataFrame, keys: Sequence[str], order: Column, value: str) -> DataFrame:
    """Replace ``value`` by its last non-null value up to the row in ``order``."""
    keys = list(keys)
    rows = _in_order(df, keys, order)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_last")
    edges = rows.groupBy(*keys, "_part").agg(last)
    entering = F.last("_last", ignorenulls=True).over(_earlier(keys))
    edges = edges.withColumn("_entering", entering).drop("_last")
    so_far = F.last(value, ignorenulls=True).over(
        Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _with_edges(rows.withColumn("_so_far", so_far), edges, keys)
        .withColumn(value, F.coalesce("_so_far", "_entering"))
        .select(*df.columns)
    )
