"""Joins between applications, jobs, seekers, candidates, logs and answers.

Where one key may hold a large share of the rows, that side is the one the
adaptive skew join can split; rows are never joined before a key's duplicates
have been aggregated away where only its presence matters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.hot_groups import carried_forward
from rankloom.session import written


def app_wide(
    applications: DataFrame, jobs: DataFrame, seekers: DataFrame, users: DataFrame
) -> DataFrame:
    return applications.join(jobs, "job_id").join(seekers, "seeker_id").join(users, "user_id")


def candidate_logs(candidates: DataFrame, logs: DataFrame) -> DataFrame:
    """Candidates with their logs, once with NULLs where there are none.

    Inner join plus anti join instead of a left join, whose right side could
    not be split when one candidate holds most logs.
    """
    with_logs = candidates.join(logs, "candidate_id")
    logged = logs.select("candidate_id").distinct()
    without = candidates.join(logged, "candidate_id", "left_anti")
    return with_logs.unionByName(without, allowMissingColumns=True)


def candidate_answers(candidates: DataFrame, bridge: DataFrame, answers: DataFrame) -> DataFrame:
    return candidates.join(bridge, "candidate_id").join(answers, "answer_id")


def answer_question_weight(
    answers: DataFrame, questions: DataFrame, weights: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Answers with question and weight, and the rejects without a weight.

    Answers to unknown questions are skipped. ``weights`` is a few dozen rows
    built from a literal, hence the broadcast.
    """
    joined = answers.join(questions, "question_id").join(
        F.broadcast(weights), ["category", "question_type"], "left"
    )
    return joined.where("weight is not null"), joined.where("weight is null").drop("weight")


def apply_once(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column
) -> DataFrame:
    """Incoming rows whose keys are new, the first one per key."""
    first = (
        incoming.groupBy(*keys)
        .agg(F.min_by(F.struct(*incoming.columns), order).alias("_row"))
        .select("_row.*")
    )
    return first.join(existing.select(*keys), list(keys), "left_anti")


def snapshot_asof(
    events: DataFrame,
    versions: DataFrame,
    key: str,
    event_time: str,
    event_id: str,
    version_time: str,
    version_id: str,
) -> DataFrame:
    """Events with the id of the version current at their time (inclusive).

    Versions and events are merged in time order per key and the version id is
    carried forward: one shuffle, no range join. Join the version's contents by
    its id afterwards.
    """
    merged = events.select(
        key, F.col(event_time).alias("_time"), F.lit(1).alias("_kind"),
        F.col(event_id).alias("_id"), F.lit(None).cast(versions.schema[version_id].dataType).alias(version_id),
    ).unionByName(
        versions.select(
            key, F.col(version_time).alias("_time"), F.lit(0).alias("_kind"),
            F.col(version_id).cast(events.schema[event_id].dataType).alias("_id"), version_id,
        )
    )
    order = F.struct("_time", "_kind", "_id")
    return (
        carried_forward(merged, [key], order, version_id)
        .where("_kind = 1")
        .select(key, F.col("_id").alias(event_id), F.col("_time").alias(event_time), version_id)
    )


def cascade_delete(removed: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """Each child table without the rows of removed parents."""
    gone = removed.select(key).distinct()
    return [child.join(gone, key, "left_anti") for child in children]


def cascade(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, str],
    references: Sequence[tuple[str, str, str]],
    removed: Mapping[str, DataFrame],
) -> dict[str, DataFrame]:
    """All tables without the removed rows and all that refer to them, directly or not.

    ``references`` are ``(child, column, parent)``: the child's column holds the
    parent's key (``keys``). Tables are taken parents first, one anti join per
    reference; a table's removed keys are stored before its children need them. A
    null reference keeps its row. References in a ring raise ``graphlib.CycleError``.
    """
    graph: dict[str, set[str]] = {name: set() for name in tables}
    for child, _, parent in references:
        graph[child].add(parent)
    gone: dict[str, DataFrame] = {}
    left: dict[str, DataFrame] = {}
    for name in TopologicalSorter(graph).static_order():
        rows, lost = tables[name], []
        if name in removed:
            lost.append((keys[name], removed[name].select(F.col(keys[name]).alias("_gone"))))
        lost += [(column, gone[parent]) for child, column, parent in references if child == name and parent in gone]
        kept = rows
        for column, keys_gone in lost:
            kept = kept.join(keys_gone.distinct(), F.col(column) == F.col("_gone"), "left_anti")
        left[name] = kept
        if lost and any(parent == name for _, _, parent in references):
            hit = [
                rows.join(keys_gone.distinct(), F.col(column) == F.col("_gone"), "left_semi").select(F.col(keys[name]).alias("_gone"))
                for column, keys_gone in lost
            ]
            gone[name] = written(reduce(DataFrame.union, hit).distinct(), f"gone-{name}")
    return left


def not_taken(invited: DataFrame, candidates: DataFrame) -> DataFrame:
    """Invited (user, job) pairs that have not submitted the test yet."""
    taken = candidates.where("test_taken").select("user_id", "job_id").distinct()
    return invited.join(taken, ["user_id", "job_id"], "left_anti")
