"""Whitening of vectors by mixed-precision eigenvectors.

Vectors become whole numbers, each different one counts once, and their exact
sums and the covariance (centred before multiplying) are gathered one row per
dimension: what reaches the driver is one matrix of the vectors' dimensions.

There the eigenvectors of the matrix in single precision are corrected by the
iteration of Ogita and Aishima, four matrix products a round in extended
precision, which squares the error each time. It divides by differences of
eigenvalues, so those nearer than the error bound form a cluster: the iteration
corrects the cluster's space, and a small problem inside it, shifted by its mean
so that its own spread is what counts, finds the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import folded, mapped
from rankloom.session import written

SCALE = 64
COMPONENTS = 16
#: Whole numbers are held to this size, so that differences fit 64 bits.
FARTHEST = 1 << 61
#: A component needs this share of the largest variance; below it is rounding.
LEAST_SHARE = 1e-11
#: Eigenvalues nearer than this share of the largest are solved as a cluster.
NEAREST = 1e-9
LONG = (1 << 63) - 1

# ---- eigenvectors ---------------------------------------------------------


def clusters(values: np.ndarray, bound: float) -> Iterator[np.ndarray]:
    """Positions of two or more eigenvalues, each at most ``bound`` from the next."""
    order = np.argsort(values)
    breaks = np.flatnonzero(np.diff(values[order]) > bound) + 1
    for run in np.split(order, breaks):
        if len(run) > 1:
            yield run


def solved_inside(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The basis ``x`` of a space that ``a`` keeps, turned to eigenvectors of ``a``."""
    k = x.shape[1]
    middle = np.trace(x.T @ a @ x) / k
    inner = x.T @ (a @ x - middle * x)
    spread = np.abs(inner).max()
    if not spread > k * np.finfo(a.dtype).eps * abs(middle):
        return x  # equal eigenvalues: one basis is as good as another
    _, turn = np.linalg.eigh(((inner + inner.T) / (2 * spread)).astype(np.float64))
    return x @ turn.astype(a.dtype)


def eigen(matrix: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    d = len(matrix)
    scale = np.abs(matrix).max(initial=0.0)
    if not scale:
        return np.zeros(d), np.eye(d)
    a = (matrix.astype(np.longdouble) + matrix.T) / (2 * np.longdouble(scale))
    _, x = np.linalg.eigh(a.astype(np.float32))
    x = x.astype(np.longdouble)
    size, last = np.linalg.norm(a.astype(np.float64), 2), np.inf
    for _ in range(rounds):
        r = np.eye(d) - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        bound = 2 * (np.linalg.norm(off.astype(np.float64), 2) + size * np.linalg.norm(r.astype(np.float64), 2))
        # At the precision wanted, or as near as rounding lets it come.
        settled = bound < 4 * np.finfo(np.float64).eps * size or last / 2 < bound < NEAREST * size
        last, bound = bound, max(bound, NEAREST * size)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > bound
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        for run in clusters(values, bound):
            x[:, run] = solved_inside(a, x[:, run])
        if settled:
            break
    x /= np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x)
    falling = np.argsort(-values, kind="stable")
    return (values[falling] * scale).astype(np.float64), x[:, falling].astype(np.float64)


# ---- vectors as whole numbers ---------------------------------------------


def _numbers(column: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``floor(scale * c)`` of all entries, where each row's begin and end, and which
    rows have a vector of finite numbers only."""
    values = column.values.cast(pa.float64())
    c = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    usable = (bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.clip(np.floor(scale * np.where(np.isfinite(c), c, 0)), -FARTHEST, FARTHEST).astype(np.int64)
    return x, offsets, usable


def _packed(x: np.ndarray) -> bytes:
    """Two bytes a number where all fit, else eight: equal rows give equal bytes."""
    small = len(x) and -(1 << 15) <= x.min() and x.max() < 1 << 15
    return x.astype("<i2" if small else "<i8").tobytes()


def _unpacked(rows: pa.RecordBatch, size: int) -> np.ndarray:
    keys = rows.column("x").to_pylist()
    return np.array([np.frombuffer(k, dtype="<i2" if len(k) == 2 * size else "<i8") for k in keys], dtype=np.int64)


def points(vectors: DataFrame, scale: int, vec_id: str, column: str) -> DataFrame:
    """``(vec_id, size, x)`` of the rows whose vector is whole and finite."""
    def batch(rows: pa.RecordBatch) -> dict:
        x, offsets, usable = _numbers(rows.column("v"), scale)
        kept = np.flatnonzero(usable)
        return {
            "vec_id": rows.column("vec_id").take(pa.array(kept)),
            "size": np.diff(offsets)[kept],
            "x": [_packed(x[offsets[i] : offsets[i + 1]]) for i in kept],
        }

    narrow = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    return mapped(narrow, "vec_id long, size int, x binary", batch)


# ---- statistics -----------------------------------------------------------


def sums_of(fit_list: DataFrame, size: int) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension (unshifted)."""
    def add(total, rows):
        x = _unpacked(rows, size)
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        n, sums = total or (0, [0] * size)
        return n + len(x), [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low, strict=True)]

    def finish(total):
        n, sums = total
        return {"i": range(size), "s": [Decimal(s) for s in sums], "n": [n] * size}

    found = folded(fit_list.select("x"), "i int, s decimal(38,0), n long", add, finish)
    rows = found.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    sums = {r.i: int(r.s) for r in rows}
    return (rows[0].n if rows else 0), [sums.get(i, 0) for i in range(size)]


def gram(fit_list: DataFrame, size: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of the outer products of ``rows_of(x)``, each of ``width`` numbers: a
    matrix for each partition, summed by matrix row."""
    def add(total, rows):
        w = rows_of(_unpacked(rows, size))
        return (0.0 if total is None else total) + w.T @ w

    def finish(total):
        return {"i": range(width), "row": list(total)}

    def add_rows(total, rows):
        total = total or {}
        for i, row in zip(rows.column("i").to_pylist(), rows.column("row").to_pylist(), strict=True):
            total[i] = total.get(i, 0.0) + np.array(row)
        return total

    def finish_rows(total):
        return {"i": list(total), "row": list(total.values())}

    schema = "i int, row array<double>"
    partial = folded(fit_list.select("x"), schema, add, finish)
    out = np.zeros((width, width))
    for r in folded(partial.repartition("i"), schema, add_rows, finish_rows).collect():
        out[r.i] += r.row
    return (out + out.T) / 2


@dataclass
class Whitening:
    """What maps vectors: of the size of one vector times the components kept."""

    size: int
    n: int
    middle: np.ndarray  # whole part of the mean
    rest: np.ndarray  # what the sums exceed n * middle by
    axes: np.ndarray  # a component a column
    values: np.ndarray
    trace: float
    scale: int
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) - self.rest / max(1, self.n)

    def projected(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``n * x`` less the sums: exact, null beyond 64 bits."""
        rough = self.n * np.abs(self.centred(x))
        fits = (rough**2).sum(axis=1) < 2.0**62
        d = self.n * (x[fits] - self.middle) - self.rest
        out: list[int | None] = [None] * len(x)
        for i, value in zip(np.flatnonzero(fits), (d * d).sum(axis=1).tolist(), strict=True):
            out[i] = value
        for i in np.flatnonzero(~fits):
            exact = sum(
                (self.n * (int(v) - int(m)) - int(r)) ** 2 for v, m, r in zip(x[i], self.middle, self.rest, strict=True)
            )
            out[i] = exact if exact <= LONG else None
        return out


def fit(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", column: str = "embedding"
) -> Whitening:
    """Learn from every different vector of ``vectors`` once."""
    found = written(points(vectors, scale, vec_id, column).select("size", "x").distinct(), "whitening-vectors")
    most = found.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = most.size if most else 0
    fit_list = found.where(F.col("size") == size)
    n, sums = sums_of(fit_list, size) if size else (0, [])
    middle = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    model = Whitening(
        size, n, np.array(middle, dtype=np.int64), np.array(rest, dtype=np.int64),
        np.zeros((size, 0)), np.zeros(0), 0.0, scale,
    )
    if n:
        covariance = gram(fit_list, size, model.centred, size) / n
        values, axes = eigen(covariance)
        kept = int((values > LEAST_SHARE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
        kept = min(kept, components)
        model.axes, model.values, model.trace = axes[:, :kept], values[:kept], float(np.trace(covariance))
        if kept:
            error = gram(fit_list, size, model.projected, kept) / n - np.eye(kept)
            model.identity_error = float(np.abs(error).max())
    return model


def whitened(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: one
    row for each usable row of ``vectors`` and component.

    Left out are rows whose vector is null, holds null, NaN or infinity, or has
    another number of entries than most different vectors (of equals the longest).
    Repeated rows stay, a null id too. Entries are held to 2^61 after scaling, and
    ``deviation`` is null where it does not fit 64 bits. A direction without variance (less
    than 1e-11 of the largest) is no component: one vector alone, equal vectors
    and no rows give no rows.
    """
    k = model.axes.shape[1]
    if not k:
        found = points(vectors, model.scale, vec_id, column).where("false").select("vec_id")
        model_columns = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return found.select("vec_id", *[F.lit(None).cast(t).alias(name) for name, t in model_columns.items()])
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # one vector's size times the components

    def batch(rows: pa.RecordBatch) -> dict:
        m: Whitening = shared.value
        x = _unpacked(rows, m.size).reshape(-1, m.size)
        each = np.repeat(np.arange(len(x)), k)
        return {
            "vec_id": rows.column("vec_id").take(pa.array(each)),
            "component": np.tile(np.arange(1, k + 1), len(x)),
            "n": np.full(len(each), m.n),
            "deviation": pa.array(m.deviations(x), pa.int64()).take(pa.array(each)),
            "whitened": m.projected(x).ravel(),
            "explained": np.tile(m.values / m.trace, len(x)),
            "identity_error": np.full(len(each), m.identity_error),
        }

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = points(vectors, model.scale, vec_id, column).where(F.col("size") == model.size)
    return mapped(usable, schema, batch, 1 << 20)
