"""A log-bilinear language model, trained by noise-contrastive estimation.

The model predicts the most frequent words, the end of a text and one class for
all rare words from the two words before: the context's vectors, weighted by
position, make a predicted vector, whose products with the output vectors give the
scores. Inside the rare class words follow their smoothed counts, so every text
has a normalised probability.

All learning texts take part. Each task runs noise-contrastive steps over its own
texts from the same start, and the parameters are averaged by the number of tokens
in one small aggregation (``rounds`` times). Word counts are one distributed
table; the frequent words travel with the model, the rest of the counts meets
the texts in a join, where no word is frequent enough to be a hot key.

Bounds: the broadcast holds ``vocabulary * dimensions`` parameters and about
``frequent_words`` counts; the driver sees no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import frequent, mapped, parts, split_words
from rankloom.session import written

VOCABULARY = 1022
DIMENSIONS = 16
FREQUENT_WORDS = 65_536
NOISE, SHARED_NOISE = 8, 64
STEP, RATE = 8192, 0.1
CHUNK = 1 << 18
SEED = 11

RARE, END = 0, 1
#: The end of a text in tables of words; no word is empty.
END_WORD = ""


@dataclass
class Parameters:
    """Output vectors and biases, context vectors (the last is the start of a text)
    and the weights of the two positions."""

    output: np.ndarray
    bias: np.ndarray
    context: np.ndarray
    position: np.ndarray

    def rows(self) -> np.ndarray:
        """All parameters as one matrix, for averaging."""
        width = self.output.shape[1]
        bias = np.zeros((-(-len(self.bias) // width), width), dtype=np.float32)
        bias.ravel()[: len(self.bias)] = self.bias
        return np.vstack([self.output, self.context, self.position, bias])

    def of_rows(self, rows: np.ndarray) -> Parameters:
        n, m = len(self.output), len(self.context)
        output, context, position, bias = np.split(rows.astype(np.float32), [n, n + m, n + m + 2])
        return Parameters(output, bias.ravel()[:n].copy(), context, position)

    def predicted(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.position[0] * self.context[first] + self.position[1] * self.context[second]


def start(counts: np.ndarray, dimensions: int = DIMENSIONS) -> Parameters:
    """Small random vectors, and biases that alone give the smoothed word shares."""
    n, rng = len(counts), np.random.default_rng(SEED)
    small = lambda rows: (rng.standard_normal((rows, dimensions)) * 0.1).astype(np.float32)
    share = (counts + 1.0) / (counts.sum() + n)
    return Parameters(small(n), np.log(share).astype(np.float32), small(n + 1), np.ones((2, dimensions), np.float32))


def _sums(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sums of their rows."""
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    return places, np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation with a rate per parameter that falls with the
    gradients it has seen. Noise words come from the smoothed word shares; the
    ones of a step are shared by its tokens, so they cost one matrix product."""

    def __init__(self, parameters: Parameters, counts: np.ndarray) -> None:
        p = parameters
        self.p = Parameters(p.output.copy(), p.bias.copy(), p.context.copy(), p.position.copy())
        share = (counts + 1.0) / (counts.sum() + len(counts))
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.cumulative = np.cumsum(share)
        self.seen = [np.full(x.shape, 1e-4, np.float32) for x in (p.output, p.bias, p.context, p.position)]
        self.rng = np.random.default_rng(SEED)

    def _move(self, which: int, target: np.ndarray, places, gradient: np.ndarray) -> None:
        self.seen[which][places] += gradient * gradient
        target[places] += RATE * gradient / np.sqrt(self.seen[which][places])

    def step(self, first: np.ndarray, second: np.ndarray, word: np.ndarray) -> None:
        p, n = self.p, len(word)
        noise = np.searchsorted(self.cumulative, self.rng.random(SHARED_NOISE) * self.cumulative[-1])
        a, b = p.context[first], p.context[second]
        q = p.position[0] * a + p.position[1] * b
        true = np.einsum("ij,ij->i", q, p.output[word]) + p.bias[word] - self.log_noise[word]
        false = q @ p.output[noise].T + (p.bias - self.log_noise)[noise]
        up = 1.0 / (1.0 + np.exp(np.clip(true, -30, 30)))
        down = (-NOISE / SHARED_NOISE) / (1.0 + np.exp(np.clip(-false, -30, 30)))
        dq = up[:, None] * p.output[word] + down @ p.output[noise]
        outputs = np.vstack([up[:, None] * q, down.T @ q])
        places, grad = _sums(np.hstack([outputs, np.concatenate([up, down.sum(axis=0)])[:, None]]), np.concatenate([word, noise]))
        contexts = _sums(np.vstack([dq * p.position[0], dq * p.position[1]]), np.concatenate([first, second]))
        positions = np.vstack([(dq * a).sum(axis=0), (dq * b).sum(axis=0)])
        self._move(0, p.output, places, grad[:, :-1])
        self._move(1, p.bias, places, grad[:, -1])
        self._move(2, p.context, *contexts)
        self._move(3, p.position, slice(None), positions / n)

    def text(self, ids: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """All tokens once, in steps."""
        for at in range(0, len(ids), STEP):
            self.step(first[at : at + STEP], second[at : at + STEP], ids[at : at + STEP])


class Tokens:
    """The tokens of a run of texts: words, and one end for each text."""

    def __init__(self, texts: pa.Array) -> None:
        self.words, word, offsets = split_words(texts)
        n, docs = len(word), len(offsets) - 1
        self.edges = offsets + np.arange(docs + 1)  # of the texts, ends included
        self.word = np.full(n + docs, len(self.words), dtype=np.int64)  # the end comes after the words
        is_end = np.zeros(n + docs, dtype=bool)
        is_end[self.edges[1:] - 1] = True
        self.word[~is_end] = word
        self.is_end = is_end

    def context(self, ids: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids one and two places before, ``begin`` beyond a text's start."""
        first, second = np.full(len(ids), begin), np.full(len(ids), begin)
        first[1:], second[2:] = ids[:-1], ids[:-2]
        starts = self.edges[:-1]
        first[starts] = second[starts] = begin
        after = starts + 1
        after = after[after < self.edges[1:]]
        second[after] = begin
        return first, second

    def per_text(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.edges[1:]] - total[self.edges[:-1]]


@dataclass
class Model:
    """Parameters, the ids of the vocabulary and what is known of the counts."""

    parameters: Parameters
    ids: dict[str, int]  # of the vocabulary, without the classes
    counts: dict[str, int]  # of the frequent words
    tokens: int
    types: int
    rare_weight: float  # of all rare words together, one unseen included
    _normalisers: np.ndarray | None = field(default=None, repr=False)

    def normalisers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Log of the summed exponentials for each context, each computed once."""
        p, side = self.parameters, len(self.parameters.context)
        if self._normalisers is None:
            self._normalisers = np.full(side * side, np.nan, dtype=np.float32)
        at = first * side + second
        new = np.unique(at[np.isnan(self._normalisers[at])])
        for begin in range(0, len(new), 2048):
            some = new[begin : begin + 2048]
            scores = p.predicted(some // side, some % side) @ p.output.T + p.bias
            top = scores.max(axis=1, keepdims=True)
            self._normalisers[some] = np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]
        return self._normalisers[at]

    def log10(self, ids: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token among the output classes."""
        p, out = self.parameters, np.empty(len(ids))
        for begin in range(0, len(ids), CHUNK):
            part = slice(begin, begin + CHUNK)
            scores = np.einsum("ij,ij->i", p.predicted(first[part], second[part]), p.output[ids[part]]) + p.bias[ids[part]]
            out[part] = (scores - self.normalisers(first[part], second[part])) / np.log(10)
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts; the empty word counts the ends."""
    def batch(rows: pa.RecordBatch) -> dict:
        words, word, _ = split_words(rows.column("text"))
        counts = np.bincount(word, minlength=len(words))
        return {"word": [*words, END_WORD], "n": np.append(counts, rows.num_rows)}

    found = mapped(docs.select("text"), "word string, n long", batch)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _ids_of(tokens: Tokens, ids: dict[str, int]) -> np.ndarray:
    get = ids.get
    return np.array([*[get(w, RARE) for w in tokens.words], END], dtype=np.int64)[tokens.word]


def _averaged(docs: DataFrame, parameters: Parameters, ids: dict[str, int], counts: np.ndarray) -> Parameters:
    """One pass over all texts in every task, then the mean weighted by tokens."""
    width = parameters.output.shape[1]
    names = [f"v{i}" for i in range(width)]
    shared = docs.sparkSession.sparkContext.broadcast((parameters, ids, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_at, known, expected = shared.value
        trainer, seen = Trainer(start_at, expected), 0
        for batch in batches:
            for part in parts(batch, 1 << 22):
                tokens = Tokens(part.column("text"))
                own = _ids_of(tokens, known)
                trainer.text(own, *tokens.context(own, len(expected)))
                seen += len(own)
        if seen:
            rows = trainer.p.rows().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), float(seen)))]
                + [pa.array(rows[:, i]) for i in range(width)],
                names=["row", "weight", *names],
            )

    schema = "row int, weight double, " + ", ".join(f"{v} double" for v in names)
    trained = docs.select("text").mapInArrow(run, schema)
    sums = trained.groupBy("row").agg(F.sum("weight").alias("weight"), *[F.sum(v).alias(v) for v in names])
    means = sorted(sums.collect())
    if not means:
        return parameters
    return parameters.of_rows(np.array([[r[v] / r.weight for v in names] for r in means]))


def fit(
    docs: DataFrame, text: str = "text", vocabulary: int = VOCABULARY, dimensions: int = DIMENSIONS,
    frequent_words: int = FREQUENT_WORDS, rounds: int = 1,
) -> tuple[Model, DataFrame]:
    """The model and the stored table of word counts, from all rows of ``docs``."""
    docs = docs.select(F.col(text).alias("text"))
    counted = written(word_counts(docs), "lm-words")
    totals = counted.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = totals.n or 0, totals.v
    known = dict(frequent(counted.where(F.col("word") != END_WORD), frequent_words).select("word", "n").collect())
    chosen = sorted(known, key=lambda w: (-known[w], w))[:vocabulary]
    ids = {w: i for i, w in enumerate(chosen, start=END + 1)}
    ends = counted.where(F.col("word") == END_WORD).select("n").collect()
    end_count = ends[0].n if ends else 0
    inside = sum(known[w] for w in chosen) + end_count
    counts = np.array([tokens - inside, end_count, *[known[w] for w in chosen]], dtype=np.float64)
    parameters = start(counts, dimensions)
    for _ in range(rounds):
        parameters = _averaged(docs, parameters, ids, counts)
    known[END_WORD] = end_count
    rare_types = types - len(chosen) - (end_count > 0)
    return Model(parameters, ids, known, tokens, types, tokens - inside + rare_types + 1.0), counted


def scored(docs: DataFrame, model: Model, counted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    ``base_score`` is the sum over the tokens of the log10 share of smoothed counts,
    ``score`` the model's log10 probability. Null and empty texts are the end
    alone. Repeated rows stay. Without learning texts all counts are 0. No rows give
    no rows. Words whose count does not travel with the model are looked up in
    ``counted`` by a join on the word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(rows: pa.RecordBatch) -> dict:
        m: Model = shared.value
        tokens = Tokens(rows.column("text"))
        ids = _ids_of(tokens, m.ids)
        n = np.array([*[m.counts.get(w, -1) for w in tokens.words], m.counts[END_WORD]])
        count = n[tokens.word]
        sure = count >= 0
        logs = np.log10(np.maximum(count, 0) + 1.0)  # 0 where the count is not here
        rare = ids == RARE
        likely = m.log10(ids, *tokens.context(ids, len(m.parameters.output)))
        # Words to be looked up, once for each text that holds them.
        text_no = np.repeat(np.arange(rows.num_rows), np.diff(tokens.edges))[~sure]
        pair, times = np.unique(text_no * (len(tokens.words) + 1) + tokens.word[~sure], return_counts=True)
        owner, word = pair // (len(tokens.words) + 1), pair % (len(tokens.words) + 1)
        ends = np.searchsorted(owner, np.arange(rows.num_rows + 1)).astype(np.int32)
        names = pa.array(tokens.words, pa.string()).take(pa.array(word))
        return {
            "doc_id": rows.column("doc_id"),
            "n_tokens": np.diff(tokens.edges),
            "known": tokens.per_text(count > 0).astype(np.int64),
            "base": tokens.per_text(logs) - np.diff(tokens.edges) * np.log10(m.tokens + m.types + 1.0),
            "likely": tokens.per_text(likely + rare * (logs - np.log10(m.rare_weight))),
            "words": pa.ListArray.from_arrays(pa.array(ends), names),
            "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(times, pa.int32())),
        }

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_tokens long, known long, base double, likely double, words array<string>, times array<int>"
    rows = mapped(narrow, schema, batch, part_bytes=1 << 22).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "lm-scores", compression="zstd")
    pairs = rows.select("_row", F.explode(F.arrays_zip("words", "times")).alias("p"))
    pairs = pairs.select("_row", F.col("p.words").alias("word"), F.col("p.times").alias("times"))
    found = pairs.join(counted, "word").groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"), F.sum("times").alias("found")
    )
    more = F.coalesce("log", F.lit(0.0))
    return rows.drop("words", "times").join(found, "_row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("likely") + more).alias("score"),
    )
