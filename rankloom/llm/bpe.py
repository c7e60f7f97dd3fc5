"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a byte string there is one token with which its encoding ends.
It is the token that ends there and may follow the encoding of what stands
before it, and whether a token may follow another is decided by undoing merges
along their border. So a table of last tokens holds the encodings of all
prefixes: bytes are appended without looking back further than the longest
token, and after an edit the table is kept up to the edit.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import mapped, once, texts_of

CACHED = 500_000
PAIRS_CACHED = 1_000_000
LONGEST_CACHED = 64


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines() if content else [])}


class Vocabulary:
    """Tokens by rank and the two tokens that each is merged from."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must have a rank")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.beyond = 2 * max(self.tokens) + 2
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.reached: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            halves = self._halves(token, rank)
            if halves is not None:
                self.reached[token] = rank
                self.parts[rank] = halves
                if len(token) > 1:
                    self.merged[halves] = rank
        self._follows: dict[int, bool] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """What earlier merges leave of a token: its two halves. A byte is both its
        halves; None for a token that merging never gives."""
        pieces = [token[i : i + 1] for i in range(len(token))]
        if len(pieces) == 1:
            return rank, rank
        while len(pieces) > 2:
            best, at = min(
                (self.ranks.get(pieces[i] + pieces[i + 1], rank), i) for i in range(len(pieces) - 1)
            )
            if best >= rank:
                return None
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return self.ranks[pieces[0]], self.ranks[pieces[1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left``: no merge across the border
        comes before the merges that made the two."""
        key = left * self.beyond + right
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > PAIRS_CACHED:
                self._follows.clear()
            known = self._follows[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # The later merge of the two is undone first; a merge across the border
        # breaks it if it is earlier than what was undone last. On equal ranks the
        # left one is made first.
        limit = self.beyond
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            left_made, right_made = self.parts[left][0] != left, self.parts[right][1] != right
            if left_made and (left > right or not right_made):
                limit, left = left, self.parts[left][1]
            elif right_made:
                limit, right = right + 1, self.parts[right][0]
            else:
                return True


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Extend the string; the encodings of the old prefixes stay."""
        v, last, start = self.vocabulary, self.last, len(self.data)
        self.data = whole = self.data + data
        token_at, follows, longest = v.reached.get, v.follows, v.longest
        for end in range(start + 1, len(whole) + 1):
            for begin in range(max(0, end - longest), end):
                token = token_at(whole[begin:end])
                if token is not None and (not begin or follows(last[begin], token)):
                    last.append(token)
                    break

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put ``data`` in the place of ``[start, end)``; only what follows
        ``start`` is encoded again."""
        rest = self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(data + rest)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, by default of all."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return out[::-1]


class Coder:
    """Encodes texts piece by piece; a piece that is a token is that token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary = Vocabulary(ranks)
        # White space as Unicode has it, without Python's information separators.
        unicode = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self._all = regex.compile(unicode).findall
        # Without numbers that are no digits, and those separators, the plain
        # classes of Python are the same.
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self._plain = None if r"\p" in plain else re.compile(plain).findall
        self._odd = regex.compile(r"[\p{Nl}\p{No}\x1c-\x1f]").search
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """What is encoded separately."""
        return self._all(text) if self._plain is None or self._odd(text) else self._plain(text)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else Prefixes(self.vocabulary, data).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.known
        pieces = self.pieces(text)
        if len(known) > CACHED:
            known.clear()
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = self._piece(p)
                if len(p) <= LONGEST_CACHED:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def coded(
    docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, ids binary, decoded binary)`` for every row, whole texts.

    ``ranks`` is the path of the rank file, which is sent to the executors, ``ids``
    are little-endian unsigned 32-bit, ``decoded`` are the bytes the ids stand for.
    Null and empty texts have no ids. Repeated rows stay; no rows give no rows.
    """
    with open(ranks, "rb") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a vocabulary: about 1 MB
    key = hashlib.sha256(content + pattern.encode()).hexdigest()

    def batch(rows: pa.RecordBatch) -> dict:
        coder = once(key, lambda: Coder(read_ranks(shared.value), pattern))
        ids = [coder.encode(t.decode()) for t in texts_of(rows)]
        return {"doc_id": rows.column("doc_id"), "ids": ids, "decoded": list(map(coder.decode, ids))}

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(narrow, "doc_id long, ids binary, decoded binary", batch, part_bytes=1 << 22)
