"""Quality by nearest neighbours among labelled latent-semantic vectors.

A text is a bag of terms: its words, their shapes (letters, digits and marks,
runs collapsed), words that repeat the one before, and how varied its words are
by steps of an eighth. Terms are hashed to a fixed number of buckets, weighted by
log frequency and inverse document frequency, and projected by a truncated
singular value decomposition fitted in numpy. The labelled vectors are broadcast;
every document meets all of them in blocked matrix products, and its nearest
neighbours vote with their cosine.

Bounds: at most ``per_class`` labelled rows of each class (those of the smallest
id hash), so the broadcast holds ``2 * per_class * dimensions`` floats and the
projection ``buckets * dimensions``, whatever the size of the data.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import in_bucket, mapped, texts_of

PER_CLASS = 2048
BUCKETS = 4096
DIMENSIONS = 48
NEIGHBOURS = 33
SHARPNESS = 8.0
BLOCK = 2048
SEED = 7
LONGEST_KEPT = 64  # bytes of a term whose hash is kept

_SHAPE = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c
    for c in range(256)
)
_RUN = re.compile(rb"([aA0])\1+")
_hashed: dict[bytes, int] = {}


def _bucket(term: bytes, buckets: int) -> int:
    if len(term) > LONGEST_KEPT:
        return zlib.crc32(term) % buckets
    got = _hashed.get(term)
    if got is None:
        if len(_hashed) > 200_000:
            _hashed.clear()
        got = _hashed[term] = zlib.crc32(term)
    return got % buckets


def terms(text: bytes, buckets: int = BUCKETS) -> dict[int, float]:
    """Term frequencies of one text by bucket."""
    words = text.split()
    out: Counter[int] = Counter()
    if not words:
        return out
    counted = Counter(words)
    for word, n in counted.items():
        out[_bucket(b"w" + word.lower(), buckets)] += n
    shapes: Counter[bytes] = Counter()
    for word, n in counted.items():
        shapes[_RUN.sub(rb"\1", word.translate(_SHAPE))] += n
    for shape, n in shapes.items():
        out[_bucket(b"s" + shape, buckets)] += n
    out[_bucket(b"again", buckets)] += sum(a == b for a, b in zip(words, words[1:]))
    out[_bucket(b"varied%d" % (8 * len(counted) // len(words)), buckets)] += len(words)
    return out


def _sparse(text: bytes, buckets: int) -> tuple[list[int], list[float]]:
    t = {k: v for k, v in terms(text, buckets).items() if v}
    return list(t), [float(v) for v in t.values()]


def _weighted(rows: list[tuple[list[int], list[float]]], weights: np.ndarray) -> np.ndarray:
    """Dense unit rows (all zero for a text without terms)."""
    x = np.zeros((len(rows), len(weights)), dtype=np.float32)
    for i, (k, v) in enumerate(rows):
        x[i, k] = np.log1p(v)
    x *= weights
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=x, where=length > 0)


@dataclass(frozen=True)
class Neighbours:
    """Term weights, projection, labelled unit vectors, their labels and weights."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def vectors_of(self, texts: list[bytes]) -> np.ndarray:
        rows = [_sparse(t, len(self.weights)) for t in texts]
        out = np.empty((len(rows), self.projection.shape[1]), dtype=np.float32)
        for start in range(0, len(rows), 256):
            out[start : start + 256] = _weighted(rows[start : start + 256], self.weights) @ self.projection
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-9)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Share of the neighbours' votes for label 1; the prior where none votes."""
        vectors = self.vectors_of(texts)
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        for start in range(0, len(vectors), BLOCK):
            cosines = vectors[start : start + BLOCK] @ self.vectors.T
            last = np.partition(cosines, -k, axis=1)[:, -k]
            text, near = np.nonzero(cosines >= last[:, None])  # with all that tie with the last
            weight = np.maximum(cosines[text, near], 0.0).astype(np.float64) ** SHARPNESS * self.votes[near]
            total = np.bincount(text, weight, minlength=len(cosines))
            good = np.bincount(text, weight * self.labels[near], minlength=len(cosines))
            voted = total > 1e-12
            out[start : start + BLOCK][voted] = good[voted] / total[voted]
        return np.clip(out, 0.0, 1.0)


def fit_rows(rows: list[tuple[list[int], list[float]]], labels: np.ndarray, totals: tuple[int, int], buckets: int, dimensions: int, neighbours: int) -> Neighbours:
    """Fit on term rows; ``totals`` are all labelled rows with label 0 and 1."""
    n = len(rows)
    prior = totals[1] / sum(totals) if sum(totals) else 0.5
    held = Counter(i for k, _ in rows for i in k)
    weights = np.zeros(buckets, dtype=np.float32)
    for i, df in held.items():
        weights[i] = np.log((1 + n) / (1 + df)) + 0.1
    x = _weighted(rows, weights)
    width = min(dimensions, n, buckets)
    if not width:
        return Neighbours(weights, np.zeros((buckets, 1), np.float32), np.zeros((0, 1), np.float32), labels, labels, prior, neighbours)
    # Randomised range finder with two power steps, then an exact small decomposition.
    probe = np.random.default_rng(SEED).standard_normal((buckets, min(width + 16, n))).astype(np.float32)
    q = np.linalg.qr(x @ probe)[0]
    for _ in range(2):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    _, _, right = np.linalg.svd(q.T @ x, full_matrices=False)
    projection = np.ascontiguousarray(right[:width].T)
    vectors = x @ projection
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, length, out=vectors, where=length > 1e-9)
    # A class sampled more thinly counts for more, so that votes follow the true shares.
    sampled = np.bincount(labels.astype(int), minlength=2)
    votes = np.array([totals[c] / max(1, sampled[c]) for c in (0, 1)])
    return Neighbours(weights, projection, vectors, labels, votes[labels.astype(int)], prior, neighbours)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    buckets: int = BUCKETS,
    dimensions: int = DIMENSIONS,
    neighbours: int = NEIGHBOURS,
    usable: Column | None = None,
) -> Neighbours:
    """Fit on ``labels`` (``doc_id``, ``quality`` 0/1) of the rows that are ``usable``.

    An id marked twice counts as its lower label; null labels and ids are left
    out, equal hashes go by the id. Of several rows with a picked id the one of the
    smallest text hash is the neighbour, so repeated rows weigh no more.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)")
    if usable is not None:
        marks = marks.where(usable)
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by_class = dict(marks.groupBy("quality").count().collect())
    picked = None
    for label in (0, 1):
        some = marks.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)

    def batch(rows: pa.RecordBatch) -> dict:
        pairs = [_sparse(t, buckets) for t in texts_of(rows)]
        return {
            "doc_id": rows.column("doc_id"), "quality": rows.column("quality"), "text_hash": rows.column("text_hash"),
            "k": [p[0] for p in pairs], "v": [p[1] for p in pairs],
        }

    # At most 2 * per_class ids on the picked side, and one row for each is collected.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").join(
        F.broadcast(picked.select(F.col("doc_id").cast("long"), "quality")), "doc_id"
    )
    found = mapped(texts, "doc_id long, quality int, text_hash long, k array<int>, v array<float>", batch)
    one = F.min_by(F.struct("quality", "k", "v"), "text_hash").alias("r")
    rows = found.groupBy("doc_id").agg(one).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: (r.doc_id, r.k))
    y = np.array([r.quality for r in rows], dtype=np.float64)
    return fit_rows([(r.k, r.v) for r in rows], y, (by_class.get(0, 0), by_class.get(1, 0)), buckets, dimensions, neighbours)


def score(docs: DataFrame, model: Neighbours, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row; null and empty texts get the prior.

    All neighbours that tie with the last one vote. Repeated rows stay and agree; no
    rows give no rows, and without a labelled row every text gets the prior, 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(rows: pa.RecordBatch) -> dict:
        return {"doc_id": rows.column("doc_id"), "score": shared.value.scores(texts_of(rows))}

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(narrow, "doc_id long, score double", batch)


def accepted(docs: DataFrame, model: Neighbours, least: float) -> DataFrame:
    """The rows of ``docs`` with at least this score, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def batch(rows: pa.RecordBatch) -> dict:
        good = pa.array(shared.value.scores(texts_of(rows)) >= least)
        kept = rows.filter(good)
        return {name: kept.column(name) for name in kept.schema.names}

    return mapped(docs, schema, batch)


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learned from: not those with remainder 0 of five."""
    return ~in_bucket(F.col(doc_id), 5, 0)
