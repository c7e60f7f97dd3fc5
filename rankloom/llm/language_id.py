"""Language identification, words first.

A word that was seen in learning scores by its log frequency in each language. An
unseen one falls back to the longest character n-grams that were seen, from four
characters down to one. A text gets the language with the highest sum.

The counts cover all rows that may be learned from, and all of them decide. The
counts in all languages of the ``most_words`` most frequent words and the
``most_grams`` most frequent n-grams are broadcast; whatever else a text holds is
looked up in the stored counts by a join on the word, and for words that are not
there by one on the n-gram.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import frequent, mapped, split_words
from rankloom.session import written

MOST_WORDS = 100_000
MOST_GRAMS = 200_000
LONGEST_GRAM = 4
LONGEST_WORD = 64
UNKNOWN = "und"


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Runs of letters in lower case: the different ones, their places, and the
    places where each text begins and the last ends."""
    return split_words(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "))


def grams_of(word: str, size: int) -> list[str]:
    """N-grams of a word between its marks; shorter words have none."""
    marked = f"^{word}$"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def pieces(word: str) -> list[str]:
    """A long run in pieces of 64 letters, each beginning with the last three of the
    one before."""
    step = LONGEST_WORD - LONGEST_GRAM + 1
    return [word[i : i + LONGEST_WORD] for i in range(0, max(1, len(word) - LONGEST_GRAM + 1), step)]


def _names(langs: list[str]) -> list[str]:
    return [f"n{i}" for i in range(len(langs))]


def word_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """``(word, batches, n0, n1, ...)``: each word's count in each of ``langs`` over all rows of
    ``docs`` (``text``, ``lang``), summed per batch before the shuffle. Runs beyond 64
    letters count in pieces of 64, which overlap so that no n-gram is lost."""
    def batch(rows: pa.RecordBatch) -> dict:
        words, word, offsets = words_of(rows.column("text"))
        own = rows.column("lang").dictionary_encode()
        lang = np.repeat(own.indices.to_numpy(zero_copy_only=False), np.diff(offsets)).astype(np.int64)
        pair, n = np.unique(lang * max(1, len(words)) + word, return_counts=True)
        size = max(1, len(words))
        short = np.array([len(w) <= LONGEST_WORD for w in words], dtype=bool)[pair % size]
        cut = Counter()
        for p, times in zip(pair[~short].tolist(), n[~short].tolist(), strict=True):
            for piece in pieces(words[p % size]):
                cut[p // size, piece] += times
        pair, n = pair[short], n[short]
        return {
            "lang": own.dictionary.take(pa.array([*(pair // size).tolist(), *(lang for lang, _ in cut)], pa.int64())),
            "word": pa.concat_arrays([
                pa.array(words, pa.string()).take(pa.array(pair % size)), pa.array([piece for _, piece in cut], pa.string()),
            ]),
            "n": [*n.tolist(), *cut.values()],
        }

    usable = docs.where("lang is not null and text is not null").select("lang", "text")
    found = mapped(usable, "lang string, word string, n long", batch)
    sums = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(n) for n, lang in zip(_names(langs), langs, strict=True)]
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("batches"), *sums)


def gram_counts(counted: DataFrame, langs: list[str], longest: int = LONGEST_GRAM) -> DataFrame:
    """``(gram, batches, n0, n1, ...)``: how many different words of each language hold an n-gram."""
    names = _names(langs)

    def batch(rows: pa.RecordBatch) -> dict:
        by = [Counter() for _ in names]
        holds = [(rows.column(name).to_numpy(zero_copy_only=False) > 0).tolist() for name in names]
        for word, *own in zip(rows.column("word").to_pylist(), *holds, strict=True):
            grams = {g for size in range(1, longest + 1) for g in grams_of(word, size)}
            for counter, held in zip(by, own, strict=True):
                if held:
                    counter.update(grams)
        keys = list(set().union(*by))
        return {"gram": keys} | {name: [c[g] for g in keys] for name, c in zip(names, by, strict=True)}

    schema = "gram string" + "".join(f", {name} long" for name in names)
    found = mapped(counted, schema, batch)
    return found.groupBy("gram").agg(F.count(F.lit(1)).alias("batches"), *[F.sum(name).alias(name) for name in names])


def _logs(counts: np.ndarray, totals: np.ndarray, types: int) -> np.ndarray:
    """Log frequencies, with half a count for what a language lacks."""
    return np.log((counts + 0.5) / (totals + 0.5 * max(1, types)))


class Model:
    """Log frequencies of the words and, by length, of the n-grams that travel."""

    def __init__(self, langs, word_rows, word_totals, word_types, gram_rows, gram_totals, gram_types) -> None:
        self.langs = langs
        self.word_totals, self.word_types = np.array(word_totals, dtype=np.float64), word_types
        self.gram_totals = {size: np.array(t, dtype=np.float64) for size, t in gram_totals.items()}
        self.gram_types = gram_types
        self.words, self.word_logs = self._table(word_rows, self.word_totals, word_types)
        self.grams = {}
        for size in sorted(gram_types, reverse=True):
            rows = [r for r in gram_rows if len(r[0]) == size]
            self.grams[size] = self._table(rows, self.gram_totals[size], gram_types[size])

    def _table(self, rows, totals, types) -> tuple[dict[str, int], np.ndarray]:
        counts = np.array([r[1:] for r in rows], dtype=np.float64).reshape(len(rows), len(self.langs))
        return {r[0]: i for i, r in enumerate(rows)}, _logs(counts, totals, types)

    def word_values(self, counts: np.ndarray) -> np.ndarray:
        return _logs(counts, self.word_totals, self.word_types)

    def asked(self, word: str) -> list[str]:
        """The n-grams that decide on an unseen word and do not travel."""
        out: list[str] = []
        for size, (index, _) in self.grams.items():
            grams = grams_of(word, size)
            if len(index) < self.gram_types[size]:
                out += [g for g in grams if g not in index]
            if any(g in index for g in grams):
                break
        return sorted(set(out))

    def unseen(self, word: str, found: dict[str, list[int]]) -> np.ndarray:
        """The mean over a word's longest n-grams that were seen; ``found`` has the
        counts of those that do not travel."""
        for size, (index, logs) in self.grams.items():
            grams = grams_of(word, size)
            here = [logs[index[g]] for g in grams if g in index]
            here += [_logs(np.array(found[g]), self.gram_totals[size], self.gram_types[size]) for g in grams if g in found]
            if here:
                return np.mean(here, axis=0)
        return np.zeros(len(self.langs))


@dataclass
class Learned:
    """What travels, and the stored counts of all words and n-grams."""

    model: Model
    words: DataFrame
    grams: DataFrame


def fit(docs: DataFrame, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Learned:
    """Learn from all rows of ``docs`` with a text and a language."""
    langs = sorted(r.lang for r in docs.where("lang is not null").select("lang").distinct().collect())
    counted = written(word_counts(docs, langs), "language-words")
    # A language without a word is not learned.
    names = _names(langs)
    totals = counted.agg(F.count(F.lit(1)), *[F.sum(name) for name in names]).first()
    held = [i for i, total in enumerate(totals[1:]) if total]
    langs, kept = [langs[i] for i in held], [F.col(names[i]).alias(f"n{j}") for j, i in enumerate(held)]
    counted, names = counted.select("word", *kept), _names(langs)
    grams = written(gram_counts(counted, langs), "language-grams")
    sizes = grams.groupBy(F.length("gram").alias("size")).agg(F.count(F.lit(1)), *[F.sum(name) for name in names]).collect()

    def most(rows: DataFrame, key: str, limit: int) -> list[tuple]:
        total = sum((F.col(name) for name in names), F.lit(0))
        chosen = frequent(rows.withColumn("_n", total), limit, "_n")
        return sorted(tuple(r) for r in chosen.select(key, *names).collect())

    model = Model(
        langs,
        most(counted, "word", most_words), [totals[1 + i] for i in held], totals[0],
        most(grams, "gram", most_grams), {r[0]: list(r[2:]) for r in sizes}, {r[0]: r[1] for r in sizes},
    )
    return Learned(model, counted, grams)


def _values(asked: DataFrame, learned: Learned, shared) -> DataFrame:
    """``(word, logs)`` of words that do not travel: by their own stored counts, else
    by their n-grams."""
    names = _names(learned.model.langs)

    def known(rows: pa.RecordBatch) -> dict:
        m: Model = shared.value
        words = rows.column("word").to_pylist()
        counts = np.array([rows.column(n).to_numpy(zero_copy_only=False) for n in names], dtype=np.float64).T
        logs = m.word_values(counts)
        asks: list[list[str]] = [[] for _ in words]
        for i in np.flatnonzero(np.isnan(counts[:, 0])):
            asks[i] = m.asked(words[i])
            if not asks[i]:
                logs[i] = m.unseen(words[i], {})
        return {"word": rows.column("word"), "logs": list(logs), "asks": asks}

    def looked_up(rows: pa.RecordBatch) -> dict:
        m: Model = shared.value
        found = [{g["gram"]: g["n"] for g in gs or []} for gs in rows.column("found").to_pylist()]
        words = rows.column("word").to_pylist()
        return {"word": rows.column("word"), "logs": [m.unseen(w, f) for w, f in zip(words, found, strict=True)]}

    first = mapped(
        asked.join(learned.words, "word", "left"), "word string, logs array<double>, asks array<string>", known, 1 << 20
    )
    first = written(first, "language-values", compression="zstd")
    asks = first.where(F.size("asks") > 0).select("word", F.explode("asks").alias("gram"))
    found = asks.join(learned.grams, "gram").groupBy("word").agg(
        # Fewer than the n-grams of one word.
        F.collect_list(F.struct("gram", F.array(*names).alias("n"))).alias("found")
    )
    open_words = first.where(F.size("asks") > 0).select("word").join(found, "word", "left")
    rest = mapped(open_words, "word string, logs array<double>", looked_up, 1 << 20)
    return written(first.where(F.size("asks") == 0).select("word", "logs").union(rest), "language-looked-up")


def predicted(docs: DataFrame, learned: Learned, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row, from the text alone.

    ``und`` and 0 for a null text, one without a letter, and a model that learned
    nothing. A text whose words and characters are all unknown gets the first
    language with an even share; of equals the first. Repeated rows stay; no rows
    give no rows.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    langs = learned.model.langs
    if not langs:
        return narrow.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(learned.model)
    names = [f"s{i}" for i in range(len(langs))]

    def batch(rows: pa.RecordBatch) -> dict:
        m: Model = shared.value
        words, word, offsets = words_of(rows.column("text"))
        n, size = rows.num_rows, max(1, len(words))
        row = np.array([m.words.get(w, -1) for w in words], dtype=np.int64)
        logs = np.zeros((len(words), len(langs)))
        logs[row >= 0] = m.word_logs[row[row >= 0]]
        text_no = np.repeat(np.arange(n), np.diff(offsets))
        # Words to be looked up, once for each text that holds them.
        away = row[word] < 0
        pair, times = np.unique(text_no[away] * size + word[away], return_counts=True)
        ends = np.searchsorted(pair // size, np.arange(n + 1)).astype(np.int32)
        asked = pa.array(words, pa.string()).take(pa.array(pair % size))
        return {
            "doc_id": rows.column("doc_id"), "some": np.diff(offsets) > 0,
            "words": pa.ListArray.from_arrays(pa.array(ends), asked),
            "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(times, pa.int32())),
        } | {name: np.bincount(text_no, logs[word, i], minlength=n) for i, name in enumerate(names)}

    sums = ", ".join(f"{name} double" for name in names)
    schema = f"doc_id long, some boolean, words array<string>, times array<int>, {sums}"
    rows = mapped(narrow, schema, batch, part_bytes=1 << 22).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "language-scores", compression="zstd")
    pairs = rows.select("_row", F.explode(F.arrays_zip("words", "times")).alias("p"))
    pairs = pairs.select("_row", F.col("p.words").alias("word"), F.col("p.times").alias("times"))
    asked = rows.select(F.explode("words").alias("word")).distinct()
    more = pairs.join(_values(asked, learned, shared), "word").groupBy("_row").agg(
        *[F.sum(F.col("times") * F.get("logs", F.lit(i))).alias(f"m{i}") for i in range(len(langs))]
    )
    total = F.array(*[F.col(name) + F.coalesce(F.col(f"m{i}"), F.lit(0.0)) for i, name in enumerate(names)])
    judged = rows.drop("words", "times").join(more, "_row", "left").select("doc_id", "some", total.alias("t"))
    judged = judged.withColumn("top", F.array_max("t"))
    best = F.get(F.array(*map(F.lit, langs)), F.array_position("t", F.col("top")).cast("int") - 1)
    share = 1 / F.aggregate("t", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    return judged.select(
        "doc_id", F.when(F.col("some"), best).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("some"), share).otherwise(0.0).alias("score"),
    )
