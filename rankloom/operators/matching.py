"""Document matching by chunk vectors.

A document's vectors travel as one list (at most one text's worth of chunks). Jobs
and resumes are dealt to blocks by hash, and an application is work of the cell of
its two blocks: only its own few columns are exchanged, and a list goes once to each
cell that has an application for it, at most as often as there are blocks, however
many applications name it. A job or resume of many applications is spread over a row
or column of cells, and a job of more than ``SLICE`` over further ones, as many as its
number asks for; that number is joined to narrow rows, which the adaptive skew join can
split. Every pair of chunks is compared inside the task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from rankloom.functions.vectors import BEST_CHUNKS, closest
from rankloom.session import written

BLOCKS = 8
SLICE = 1 << 18
PART_BYTES = 1 << 24
JOB, RESUME, APPLICATION = 0, 1, 2


def chunk_lists(chunks: DataFrame) -> DataFrame:
    """``(doc_id, chunk_no, vector)`` rows to one vector list per document."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "vector")))
    return chunks.groupBy("doc_id").agg(parts.alias("_p")).select(
        "doc_id", F.col("_p.vector").alias("vectors")
    )


def _places(ids: pa.Array, names: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which of ``ids`` meets which place in ``names``; null for one that is not there."""
    rows = pa.table({"id": ids, "row": np.arange(len(ids))})
    found = rows.join(pa.table({"id": names, "at": np.arange(len(names))}), "id", join_type="left outer")
    return found["row"].to_numpy(), found["at"].combine_chunks()


def _compared(rows: pa.RecordBatch, lists: list[pa.Table]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Portions of ``(_row, _best, _n)`` of a cell's applications."""
    jobs, resumes = lists
    row, job = _places(rows.column("_jd"), jobs["_id"])
    again, resume = _places(rows.column("_resume").take(pa.array(row)), resumes["_id"])
    row, job = row[again], job.take(pa.array(again))
    each = 1 + sum(t["vectors"].nbytes // max(1, len(t)) for t in lists)
    step = max(1, PART_BYTES // each)
    for at in range(0, len(row), step):
        offered = _array(resumes["vectors"].take(resume[at:at + step]))
        best = closest(_array(jobs["vectors"].take(job[at:at + step])), offered)
        yield rows.column("_row").take(pa.array(row[at:at + step])), best, offered.value_lengths().cast(pa.int64())


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _matched(applications: DataFrame, job_vectors: DataFrame, resume_vectors: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``applications`` with ``_best`` and the number ``_n`` of the resume's vectors."""
    def block(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(blocks))

    # A hot job's applications are dealt by resume to slices with cells of their own.
    sizes = applications.groupBy(F.col("jd_id").alias("_job")).agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("_slices"))
    sizes = written(sizes, "job-sizes")  # a plain side, so that the join can be split
    placed = applications.join(sizes, F.col("jd_id") == F.col("_job"), "left")
    slice_no = F.pmod(F.xxhash64("resume_id", F.lit(1)), F.coalesce("_slices", F.lit(1)))
    placed = placed.withColumn("_cell", (slice_no * blocks + block("jd_id")) * blocks + block("resume_id"))

    def sent(vectors: DataFrame, name: str, kind: int) -> DataFrame:
        """The lists that each cell asks for."""
        # An exchange of its own: else the adaptive join by job could not be split.
        wanted = placed.select("_cell", F.col(name).alias("_key")).repartition("_cell", "_key").distinct()
        return wanted.join(vectors.select("doc_id", "vectors"), F.col("_key") == F.col("doc_id")).select(
            "_cell", F.lit(kind).alias("_kind"), F.col("_key").cast("string").alias("_id"), "vectors"
        )

    apps = placed.select(
        "_cell", F.lit(APPLICATION).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in applications.columns]).alias("_row"),
        F.col("jd_id").cast("string").alias("_jd"), F.col("resume_id").cast("string").alias("_resume"),
    )
    rows = (
        sent(job_vectors, "jd_id", JOB)
        .union(sent(resume_vectors, "resume_id", RESUME))
        .unionByName(apps, allowMissingColumns=True)
        .repartition("_cell")
        .sortWithinPartitions("_cell", "_kind")
    )
    schema = StructType([rows.schema["_row"], StructField("_best", BEST_CHUNKS), StructField("_n", LongType())])
    arrow = to_arrow_schema(schema)
    sides = pa.schema([to_arrow_schema(rows.schema).field(c) for c in ("_id", "vectors")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, lists = None, ([], []), None
        for batch in batches:
            place = batch.column("_cell").to_numpy() * 3 + batch.column("_kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for a, b in pairwise(edges if len(place) else []):
                now, kind = divmod(int(place[a]), 3)
                if now != cell:  # lists come before the applications of their cell
                    cell, held, lists = now, ([], []), None
                part = batch.slice(a, b - a)
                if kind != APPLICATION:
                    held[kind].append(pa.RecordBatch.from_arrays([part.column(c).cast(sides.field(c).type) for c in sides.names], schema=sides))
                    continue
                if lists is None:
                    lists = [pa.Table.from_batches(h, sides).combine_chunks() for h in held]
                    held = ([], [])
                for found in _compared(part, lists):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(found, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema).select("_row.*", "_best", "_n")


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(values))


def chunk_maxsim(applications: DataFrame, job_vectors: DataFrame, resume_vectors: DataFrame) -> DataFrame:
    """Score per application: the mean over the job's chunks of the highest
    cosine any chunk of the resume reaches; NULL when either has no chunks."""
    return (
        _matched(applications, job_vectors, resume_vectors)
        .withColumn("score", _mean(F.col("_best.similarity")))
        .drop("_best", "_n")
    )


def best_chunk(applications: DataFrame, job_vectors: DataFrame, resume_vectors: DataFrame) -> DataFrame:
    """Per application and job chunk the resume chunk that answers it."""
    return (
        _matched(applications, job_vectors, resume_vectors)
        # Outer, lest the optimizer tests the list's size by comparing twice.
        .select("*", F.posexplode_outer("_best").alias("jd_chunk", "_hit"))
        .where("jd_chunk is not null")
        .select("*", "_hit.resume_chunk", "_hit.similarity")
        .drop("_best", "_hit", "_n")
    )


def chunk_cross(applications: DataFrame, job_vectors: DataFrame, resume_vectors: DataFrame) -> DataFrame:
    """What the comparison of all chunk pairs of an application amounts to:
    number of pairs, lowest, mean and highest similarity."""
    pairs = F.size("_best") * F.col("_n")
    total = F.aggregate(F.col("_best.total"), F.lit(0.0), lambda acc, x: acc + x)
    return (
        _matched(applications, job_vectors, resume_vectors)
        .withColumns(
            {
                "pairs": pairs,
                "lowest": F.array_min("_best.lowest"),
                "mean": F.try_divide(total, pairs),
                "highest": F.array_max("_best.similarity"),
            }
        )
        .drop("_best", "_n")
    )
