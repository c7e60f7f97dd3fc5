"""Vector arithmetic on ``array<float>`` columns, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

MATCH_DISTANCE = 0.6  # fixed value: two descriptors closer than this match
BLOCK = 4_000_000  # numbers per matrix product, 32 MB


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(v: Column) -> Column:
    """``v / |v|``; a zero vector stays as it is."""
    length = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))
    return F.element_at(
        F.transform(length, lambda n: F.transform(_doubles(v), lambda x: x / n)), 1
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(
        _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))
    )


def vector_match(a: Column, b: Column, threshold: float = MATCH_DISTANCE) -> Column:
    return distance(a, b) < threshold


BEST_CHUNKS = ArrayType(
    StructType(
        [
            StructField("resume_chunk", IntegerType()),
            StructField("similarity", DoubleType()),
            StructField("lowest", DoubleType()),
            StructField("total", DoubleType()),
        ]
    )
)


def _unit_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All vectors of a batch as unit rows (zero vectors as NaN), with the
    number of vectors and the first row of each list."""
    vectors = lists.flatten()
    counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    length[length == 0] = np.nan
    return rows / length[:, None], counts, np.cumsum(counts) - counts


def _same_shape(shapes: np.ndarray, used: np.ndarray, numbers: np.ndarray):
    """Row numbers by shape, in portions of about BLOCK numbers."""
    for shape in np.unique(shapes[used]):
        rows = np.flatnonzero(used & (shapes == shape))
        step = max(1, BLOCK // int(numbers[rows[0]]))
        for at in range(0, len(rows), step):
            yield rows[at:at + step]


def closest(wanted: pa.Array, offered: pa.Array) -> pa.Array:
    """Per row: for each vector of ``wanted`` the closest vector of ``offered``.

    Both are lists of equally long vectors. Rows with lists of the same lengths
    share one matrix product, and no pair of chunks ever becomes a row of its
    own. The first of equally close vectors wins; a comparison with a zero
    vector yields NULL, as does a row without vectors on either side.
    """
    w, count_w, start_w = _unit_rows(wanted)
    o, count_o, start_o = _unit_rows(offered)
    if len(w) and len(o) and w.shape[1] != o.shape[1]:
        raise ValueError(f"vectors of {w.shape[1]} and {o.shape[1]} elements compared")
    used = (count_w > 0) & (count_o > 0)
    out_count = np.where(used, count_w, 0)
    out_start = np.cumsum(out_count) - out_count
    total = int(out_count.sum())
    best = np.zeros(total, dtype=np.int32)
    top, low, mass = np.empty(total), np.empty(total), np.empty(total)
    shapes = count_w * (count_o.max(initial=0) + 1) + count_o
    for rows in _same_shape(shapes, used, (count_w + count_o) * max(w.shape[1], 1) + count_w * count_o):
        cw, co = int(count_w[rows[0]]), int(count_o[rows[0]])
        left = w[start_w[rows][:, None] + np.arange(cw)]
        right = o[start_o[rows][:, None] + np.arange(co)]
        similar = np.matmul(left, right.transpose(0, 2, 1))
        at = (out_start[rows][:, None] + np.arange(cw)).ravel()
        blank = np.isnan(similar)
        best[at] = np.where(blank, -np.inf, similar).argmax(axis=2).ravel()
        top[at] = np.where(blank, -np.inf, similar).max(axis=2).ravel()
        low[at] = np.where(blank, np.inf, similar).min(axis=2).ravel()
        mass[at] = np.where(blank, 0.0, similar).sum(axis=2).ravel()
    nothing = np.isneginf(top)
    fields = [
        pa.array(best, pa.int32(), mask=nothing),
        pa.array(top, pa.float64(), mask=nothing),
        pa.array(low, pa.float64(), mask=nothing),
        pa.array(mass, pa.float64(), mask=nothing),
    ]
    hits = pa.StructArray.from_arrays(fields, [f.name for f in BEST_CHUNKS.elementType])
    offsets = np.append(out_start, total)
    ends = pa.array(offsets, pa.int32(), mask=np.append(~used, False))
    return pa.ListArray.from_arrays(ends, hits)


best_chunks = F.arrow_udf(closest, BEST_CHUNKS)
