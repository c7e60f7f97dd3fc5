"""Packing token sequences into windows by minimum bin slack.

Documents longer than a window are cut at its multiples; what fills a window is
one, the rest are remainders shorter than it. Of these only the number per length
reaches the driver, at most one row for each length below the window. There a
window takes the longest remainder left and the multiset of further ones that
comes closest to filling it, found by a bitset subset sum and walked back to
counts per length. The pattern is used as often as the counts allow, so each
uses a length up and there are fewer patterns than lengths.

Pieces are numbered within their length by one range exchange and an offset for
each partition, so no group is ever in one task, and take their places from the
broadcast patterns.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from itertools import chain, compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import mapped, numbered, once
from rankloom.session import written

WINDOW = 4096
END = 2
CACHED = 400_000
LONGEST_CACHED = 64
WORD_END = "</w>"

# ASCII marks without the apostrophe, and a letter of Latin-1 in UTF-8.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile(rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]").match
PLAIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]+$"
TOGETHER = 200


class Generation:
    """Words with their ids, end to end in one growing buffer of the narrowest type."""

    def __init__(self, dtype: type) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, dtype=dtype)
        self.ends = np.zeros(1 << 14, dtype=np.int64)  # where each word's ids end

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New words and their ids, end to end; returns the words' numbers."""
        n, filled = len(self.number), int(self.ends[len(self.number)])
        self.ids = _grown(self.ids, filled + len(ids))
        self.ends = _grown(self.ends, n + len(words) + 1)
        self.ids[filled : filled + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = filled + np.cumsum(sizes)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        return np.arange(n, n + len(words))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, -1 for those that are not there."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def laid_out(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, end to end, and where each word's end."""
        first = self.ends[number]
        sizes = self.ends[number + 1] - first
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(first - (ends - sizes), sizes)], ends


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    out = np.zeros(max(size, 2 * len(values)), dtype=values.dtype)
    out[: len(values)] = values
    return out


class WordCoder:
    """Ids of texts, word by word. The normaliser and the pattern of the
    vocabulary never look across ASCII white space, nor from a letter or digit into
    the marks behind it, so a word's ids do not depend on its neighbours, and
    repeated words are looked up. Words are kept in two generations: when the newer
    is full the older leaves, but for what was used since."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True  # in a text they are ordinary text
        ids = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, dtype=bool)
        self.ends[[i for token, i in ids.items() if token.endswith(WORD_END)]] = True
        # For words that need no normalising and no pattern.
        self.light = Tokenizer.from_str(vocabulary)
        self.light.normalizer = normalizers.Sequence([])
        self.light.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ])
        self.dtype = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.newer, self.older = Generation(self.dtype), Generation(self.dtype)

    def _of_words(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in another order, their ids end to end, and how many each has."""
        # Words of letters up to Latin Extended-A are composed already, are lowered
        # letter by letter and are one pre-token each: many are coded at a time and
        # taken apart at the ends of words.
        plain = pc.match_substring_regex(pa.array(words, pa.binary()).cast(pa.string()), PLAIN).to_pylist()
        some, rest = list(compress(words, plain)), list(compress(words, map(not_, plain)))
        ids, sizes = [np.empty(0, dtype=self.dtype)], [np.empty(0, dtype=np.int64)]
        for start in range(0, len(some), TOGETHER):
            text = b" ".join(some[start : start + TOGETHER]).decode().lower()
            [coded] = self.light.encode_batch_fast([text], add_special_tokens=False)
            ids.append(np.array(coded.ids, dtype=self.dtype))
            sizes.append(np.diff(np.flatnonzero(self.ends[ids[-1]]), prepend=-1))
        for start in range(0, len(rest), TOGETHER):
            texts = [w.decode() for w in rest[start : start + TOGETHER]]
            found = [c.ids for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(found), dtype=self.dtype))
            sizes.append(np.fromiter(map(len, found), dtype=np.int64))
        return some + rest, np.concatenate(ids), np.concatenate(sizes)

    def _coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids end to end, and how many each has; marks at a word's end
        are words of their own."""
        halves, count = [], []
        for w in words:
            base = w.rstrip(MARKS)
            if 0 < len(base) < len(w) and (base[-1:].isalnum() or _LATIN(base, len(base) - 2)):
                halves += (base, w[len(base) :])
                count.append(2)
            else:
                halves.append(w)
                count.append(1)
        found = Generation(self.dtype)
        found.add(*self._of_words(list(dict.fromkeys(halves))))
        ids, ends = found.laid_out(found.find(halves))
        return ids, np.diff(ends[np.cumsum(np.array(count, dtype=np.int64)) - 1], prepend=0)

    def _numbers(self, words: list[bytes]) -> tuple[Generation, np.ndarray]:
        """Where the words' ids are."""
        if len(self.newer.number) + len(words) > CACHED:
            self.older, self.newer = self.newer, Generation(self.dtype)
        newer, older = self.newer, self.older
        number = newer.find(words)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            known = older.find([words[i] for i in missing])
            used = known >= 0
            ids, ends = older.laid_out(known[used])
            number[missing[used]] = newer.add([words[i] for i in missing[used]], ids, np.diff(ends, prepend=0))
            new = [words[i] for i in missing[~used]]
            number[missing[~used]] = newer.add(new, *self._coded(new))
        return newer, number

    def encode(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids of each text (null is empty), unsigned 32-bit."""
        texts = pc.ascii_lower(pc.fill_null(texts, ""))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        long = [w for w in words if len(w) > LONGEST_CACHED]
        if long:  # coded for this batch alone
            here = Generation(self.dtype)
            short = [w for w in words if len(w) <= LONGEST_CACHED]
            kept, number = self._numbers(short)
            ids, ends = kept.laid_out(number)
            here.add(short, ids, np.diff(ends, prepend=0))
            here.add(long, *self._coded(long))
            number = here.find(words)
        else:
            here, number = self._numbers(words)
        ids, ends = here.laid_out(number[coded.indices.to_numpy(zero_copy_only=False)])
        ids = ids.astype("<u4")
        offsets = split.offsets.to_numpy()
        edges = np.concatenate([[0], ends])[offsets - offsets[0]]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            yield ids[start:end]


def _compressed(value: bytes) -> bytes:
    return len(value).to_bytes(4, "little") + pa.compress(value, codec="zstd", asbytes=True)


def _whole(value: bytes) -> bytes:
    return pa.decompress(value[4:], int.from_bytes(value[:4], "little"), codec="zstd", asbytes=True)


def tokenised(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END,
    doc_id: str = "doc_id", text: str = "text", compressed: bool = False,
) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids)``: every row's ids and the end id,
    cut at multiples of the window. ``ids`` are little-endian unsigned 32-bit.
    ``compressed`` ids are for ``pack``. ``vocabulary`` is the tokenizer's file. A null or empty text is the end id alone."""
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a vocabulary: a few MB
    key = hashlib.sha256(content.encode()).hexdigest()
    last = np.array([end], dtype="<u4").tobytes()

    def batch(rows: pa.RecordBatch) -> dict:
        coder = once(key, lambda: WordCoder(shared.value))
        out = defaultdict(list)
        for doc, ids in zip(rows.column("doc_id").to_pylist(), coder.encode(rows.column("text")), strict=True):
            n = len(ids) + 1
            for start in range(0, n, window):
                piece = ids[start : start + window].tobytes()
                if start + window >= n:
                    piece += last
                for name, value in (
                    ("doc_id", doc), ("start", start), ("length", len(piece) // 4), ("doc_tokens", n),
                    ("ids", _compressed(piece) if compressed else piece),
                ):
                    out[name].append(value)
        return out

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary"
    return mapped(narrow, schema, batch, part_bytes=1 << 22)


def closest_fill(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """How many of each length together come closest to ``room`` without passing
    it; longer ones are preferred. One bit per reachable sum."""
    reach, mask, trail = 1, (1 << room + 1) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left = min(counts[length], room // length)
        bundle = 1
        while left:
            take = min(bundle, left)
            grown = reach | (reach << take * length) & mask
            if grown != reach:
                trail.append((length, take, reach))
                reach = grown
            left -= take
            bundle *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(trail):
        if not before >> total & 1:  # this sum needs the bundle
            used[length] += take
            total -= take * length
    return dict(used)


def patterns(counts: Mapping[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Windows as ``(number of each length, times used)`` that use all lengths up."""
    left = {x: n for x, n in counts.items() if n}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = closest_fill(left, window - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[x] // k for x, k in fill.items())
        out.append((fill, times))
        for x, k in fill.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return out


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: columns first rank, number per window, first sequence, offset."""
    rows, used, sequence = defaultdict(list), defaultdict(int), 0
    for fill, times in plan:
        offset = 0
        for length in sorted(fill, reverse=True):
            k = fill[length]
            rows[length].append((used[length], k, sequence, offset))
            used[length] += k * times
            offset += k * length
        sequence += times
    return {x: np.array(v, dtype=np.int64).T for x, v in rows.items()}


def pack(
    pieces: DataFrame, window: int = WINDOW, order: tuple[str, ...] = ("doc_id", "start"),
    compressed: tuple[str, ...] = (),
) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``window``) with ``sequence_id`` and ``offset``.

    Every piece keeps its row and columns and lies in one sequence, gapless from
    offset 0. Columns that came ``compressed`` are whole again. Repeated rows are
    pieces of their own. No rows give no rows; a null
    length or one beyond the window is an error.
    """
    # Stored first: the range exchange reads its input twice, once for a sample.
    ranked = numbered(written(pieces, "pieces"), "length", list(order), "numbered-pieces")
    counts = ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    if any(r.length is None or not 1 <= r.length <= window for r in counts):
        raise ValueError("a piece is empty or longer than the window")
    places = _places(patterns({r.length: r.n for r in counts}, window))
    shared = pieces.sparkSession.sparkContext.broadcast(places)  # fewer patterns than lengths

    columns = pieces.columns

    def batch(rows: pa.RecordBatch) -> dict:
        length = rows.column("length").to_numpy(zero_copy_only=False)
        rank = rows.column("rank").to_numpy(zero_copy_only=False)
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for x in np.unique(length):
            at = length == x
            first, k, base, start = shared.value[int(x)]
            row = np.searchsorted(first, rank[at], side="right") - 1
            inside = rank[at] - first[row]
            sequence[at] = base[row] + inside // k[row]
            offset[at] = start[row] + inside % k[row] * x
        out = {name: rows.column(name) for name in columns}
        for name in compressed:
            out[name] = [None if x is None else _whole(x) for x in out[name].to_pylist()]
        return out | {"sequence_id": sequence, "offset": offset}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    # Smaller runs of rows where they grow.
    return mapped(ranked, f"{schema}, sequence_id long, offset long", batch, 1 << 20 if compressed else 1 << 23)
