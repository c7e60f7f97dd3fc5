"""Spelling variants of words by PartEnum signatures of their letters.

The letters of a word, each with its occurrence number, are a binary vector. One
inserted or deleted letter changes one element of it, a replaced one two. The
elements are dealt to parts of about equal weight; words of one length that differ
in two elements agree in all parts but two, words whose lengths differ by one in all
but one. So a word has one signature for each choice of parts to leave out, hashed
with the shorter word's length: near words share a signature, and an equi-join on
it finds every one. What it finds is verified by the edit distance.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import mapped
from rankloom.llm.one_permutation import mix
from rankloom.session import written

# ---- fixed values -------------------------------------------------------
NOT_LETTERS = r"[^A-Za-z\x{00C0}-\x{00FF}]+"
SLIP = 31
LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10
# ---- end of fixed values ------------------------------------------------

PARTS = 4


def runs_of(texts: pa.Array, least: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different letter runs of at least ``least`` code points with A-Z
    lower-cased, the run at each place, and the text at each place."""
    spaced = pc.ascii_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), NOT_LETTERS, " "))
    split = pc.ascii_split_whitespace(spaced)
    coded = split.flatten().dictionary_encode()
    run = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = split.offsets.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(split)), np.diff(offsets))
    long = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False) >= least
    number = np.cumsum(long) - 1
    kept = long[run]
    return coded.dictionary.filter(pa.array(long)).to_pylist(), number[run[kept]], text[kept]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """``(word, n)``: the words of all texts of at least ``least`` code points. Every
    31st run, by the checksum of document and run, has lost a letter."""
    def batch(rows: pa.RecordBatch) -> dict:
        ids = ["" if i is None else str(i) for i in rows.column("doc_id").to_pylist()]
        begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.int64)
        runs, run, owner = runs_of(rows.column("text"), least)
        coded, size, total = [r.encode() for r in runs], max(1, len(runs)), Counter()
        pair, times = np.unique(owner * size + run, return_counts=True)
        crc = zlib.crc32
        sums = np.fromiter(
            (crc(coded[r], c) for r, c in zip((pair % size).tolist(), begun[pair // size].tolist(), strict=True)),
            dtype=np.int64, count=len(pair),
        )
        slipped = sums % SLIP == 0
        n = np.bincount((pair % size)[~slipped], times[~slipped], minlength=len(runs)).astype(np.int64)
        total.update({r: k for r, k in zip(runs, n.tolist(), strict=True) if k})
        for r, h, k in zip((pair % size)[slipped].tolist(), sums[slipped].tolist(), times[slipped].tolist(), strict=True):
            word = runs[r]
            at = h % len(word)
            if len(word) > least:
                total[word[:at] + word[at + 1 :]] += k
        return {"word": list(total), "n": list(total.values())}

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(narrow, "word string, n long", batch).groupBy("word").agg(F.sum("n").alias("n"))


# ---- signatures -------------------------------------------------------------


def elements(word: str) -> list[tuple[str, int]]:
    """The letters with their occurrence numbers."""
    seen: Counter = Counter()
    out = []
    for letter in word:
        out.append((letter, seen[letter]))
        seen[letter] += 1
    return out


def dealt_elements(words: DataFrame, parts: int) -> dict[tuple[str, int], int]:
    """The part of each element that occurs in ``words``, the weightiest first, each
    to the lightest part. As many rows as an alphabet has letters times the longest
    repeat in a word; first occurrences apart, all of a number go together."""
    def batch(rows: pa.RecordBatch) -> dict:
        found = Counter(e for word in rows.column("word").to_pylist() for e in elements(word))
        return {"letter": [e[0] for e in found], "no": [e[1] for e in found], "n": list(found.values())}

    found = mapped(words.select("word"), "letter string, no int, n long", batch)
    rows = found.where(F.col("no") < 4).groupBy("letter", "no").agg(F.sum("n").alias("n")).collect()
    load, part = [0] * parts, {}
    for r in sorted(rows, key=lambda r: (-r.n, r.letter, r.no)):
        lightest = load.index(min(load))
        part[r.letter, r.no] = lightest
        load[lightest] += r.n
    return part


def part_hashes(words: list[str], part: dict[tuple[str, int], int], parts: int) -> np.ndarray:
    """For each word and part the sum of its elements' hashes."""
    out = np.zeros((len(words), parts), dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), size)
    code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    # Occurrence numbers: places within runs of the same letter of the same word.
    order = np.lexsort((code, owner))
    o, c = owner[order], code[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (c[1:] != c[:-1])
    at = np.arange(len(o))
    no = at - np.maximum.accumulate(np.where(new, at, 0))
    key = c * 64 + np.minimum(no, 4)
    kinds, kind = np.unique(key, return_inverse=True)
    where = np.array([part.get((chr(k // 64), k % 64), k % parts) for k in kinds.tolist()], dtype=np.int64)
    np.add.at(out, (o, where[kind]), mix((c * (1 << 20) + no).astype(np.uint64)))
    return out


def _halves(words: list[str], lengths: list[int]) -> list[np.ndarray]:
    """Hashes of the first half and of the rest, as long as a word of such a length
    has them: one edit leaves either alone."""
    digest = xxhash.xxh64_intdigest
    first = (digest(w[: n // 2].encode()) for w, n in zip(words, lengths, strict=True))
    last = (digest(w[len(w) - (n - n // 2) :].encode()) for w, n in zip(words, lengths, strict=True))
    return [np.fromiter(each, dtype=np.uint64, count=len(words)) for each in (first, last)]


def signatures(words: list[str], part: dict[tuple[str, int], int], parts: int) -> np.ndarray:
    """A row of signatures for each word: two parts left out, told apart by length,
    then one part left out as the shorter word and as the longer. Each comes with
    the first half of the letters in order, and with the rest."""
    each = part_hashes(words, part, parts)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    total = each.sum(axis=1, dtype=np.uint64)
    columns = []

    def add(left_out: np.ndarray, kind: int, shorter: np.ndarray, halves: list[np.ndarray]) -> None:
        for side, half in enumerate(halves):
            tag = (np.uint64(2 * kind + side) << np.uint64(32)) + shorter.astype(np.uint64)
            columns.append(mix(mix(mix(total - left_out) + half) + tag))

    own, lower = _halves(words, size.tolist()), _halves(words, (size - 1).tolist())
    for kind, (i, j) in enumerate(itertools.combinations(range(parts), 2)):
        add(each[:, i] + each[:, j], kind, size, own)
    for i in range(parts):
        kind = parts * (parts - 1) // 2 + i
        add(each[:, i], kind, size, own)
        add(each[:, i], kind, size - 1, lower)
    return np.stack(columns, axis=1)


# ---- near words ---------------------------------------------------------------


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``(a, b, na, nb)``: the pairs ``a < b`` of ``words`` (``word, n``, no word twice)
    that one inserted, deleted or replaced code point tells apart."""
    part = dealt_elements(words, parts)  # as large as an alphabet
    width = 2 * (parts * (parts - 1) // 2 + 2 * parts)

    def batch(rows: pa.RecordBatch) -> dict:
        found = signatures(rows.column("word").to_pylist(), part, parts).view(np.int64)
        ends = np.arange(len(found) + 1, dtype=np.int32) * width
        return {
            "word": rows.column("word"), "n": rows.column("n"),
            "sigs": pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel())),
        }

    signed = mapped(words.select("word", "n"), "word string, n long, sigs array<long>", batch, 1 << 20)
    # Stored, so that both sides are plain exchanges of one table.
    signed = written(signed, "spelling-signatures", compression="zstd")
    one = signed.select(F.explode("sigs").alias("sig"), F.col("word").alias("a"), F.col("n").alias("na"))
    two = one.select("sig", F.col("a").alias("b"), F.col("na").alias("nb"))
    together = one.join(two, "sig").where("a < b")
    return together.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "na", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last word that ``forms`` (``word, form``, without rings)
    leads to. Each round doubles the steps taken."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(now.join(ahead, "root", "left"), "spelling-roots")
        if moved.where("further is not null").isEmpty():
            return now
        now = moved.select("word", F.coalesce("further", "root").alias("root"))


def variants(
    docs: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES, parts: int = PARTS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each different word that occurs
    ``least_count`` times in all texts.

    ``form`` is the most frequent near word (of equals the first in code-point order)
    if it occurs at least ``times`` times as often, else null; ``root`` is where forms
    lead in the end, the word itself without any. Null and empty texts have no word;
    a null id counts as empty text before the run's colon. Repeated rows count as
    often as they are there. No rows give no rows.
    """
    words = written(word_counts(docs, doc_id, text).where(F.col("n") >= least_count), "spelling-words")
    pairs = written(near_pairs(words, parts), "spelling-pairs", compression="zstd")
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("na").alias("own"), F.col("b").alias("other"), F.col("nb").alias("n")),
        F.struct(F.col("b").alias("word"), F.col("nb").alias("own"), F.col("a").alias("other"), F.col("na").alias("n")),
    )
    near = pairs.select(F.inline(ways)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.max("own").alias("own"),
        F.min(F.struct((-F.col("n")).alias("less"), F.col("other").alias("word"))).alias("best"),
    )
    likely = -F.col("best.less") >= times * F.col("own")
    near = written(
        near.select(
            "word", "n_near", F.when(likely, F.col("best.word")).alias("form"),
            F.when(likely, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-near",
    )
    found = words.join(near, "word", "left").join(roots(near.where("form is not null")), "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )
