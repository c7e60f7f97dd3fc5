"""Shards of near equal size by histogram sort.

Rows are ordered by a key of two longs. For each border between shards a few
probes are laid into the bracket of keys that must hold it; one pass counts the
exact bytes and the first and last key between neighbouring probes; the bracket
shrinks to the interval that holds the target, and on until every border is
within tolerance or falls between two neighbouring keys. Then the rows are
exchanged once, by range, and numbered within their shard.

The driver sees ``shards * probes`` counts a round, whatever the size of the data.
The key is the hash of a text and its id: equal texts lie together, and however
many there are, a border may fall between them.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import numbered
from rankloom.session import written

HALF = 1 << 63
TOLERANCE = 0.002
PROBES = 7


def _joined(high: int, low: int) -> int:
    """A key as one whole number in the same order."""
    return (high + HALF << 64) + low + HALF


def _literal(value: int) -> str:
    return f"{value}L" if value > -HALF else f"({value + 1}L - 1L)"


def interval(keys: list[int]) -> Column:
    """How many of the sorted ``keys`` are at or below a row's key, by bisection."""
    def search(first: int, last: int) -> str:
        if first == last:
            return str(first)
        middle = (first + last) // 2
        high, low = (_literal(x - HALF) for x in divmod(keys[middle], 1 << 64))
        below = f"_high < {high} or (_high = {high} and _low < {low})"
        return f"case when {below} then {search(first, middle)} else {search(middle + 1, last)} end"

    return F.expr(search(0, len(keys)))


@dataclass
class Bracket:
    """A border at ``target`` bytes lies in ``[low, high]``, with the bytes below each."""

    target: float
    low: int
    below_low: int
    high: int
    below_high: int
    border: int | None = None

    def probes(self, n: int) -> list[int]:
        room = self.high - self.low
        return sorted({self.low + room * i // (n + 1) for i in range(1, n + 1)} - {self.low, self.high})

    def settle(self, allowed: float) -> None:
        """Take the nearer end if it is near enough or nothing lies between."""
        left, right = self.target - self.below_low, self.below_high - self.target
        if min(left, right) <= allowed or self.high - self.low <= 1:
            self.border = self.low if left <= right else self.high


def borders(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """The ``shards - 1`` borders of ``keys`` (``_high``, ``_low``, ``_size``): a row
    lies in the shard of as many borders as are at or below its key."""
    key = F.struct("_high", "_low")
    whole = keys.agg(F.sum("_size").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).first()
    if whole.n is None:
        return [0] * (shards - 1)
    first, last = _joined(*whole.a), _joined(*whole.b)
    allowed = tolerance * whole.n / shards
    brackets = [Bracket(whole.n * j / shards, first, 0, last + 1, whole.n) for j in range(1, shards)]
    for b in brackets:
        b.settle(allowed)
    while open_ones := [b for b in brackets if b.border is None]:
        # The ends are counted again, so that every interval belongs to one bracket.
        tried = sorted({p for b in open_ones for p in (b.low, *b.probes(probes), b.high)})
        counted = keys.groupBy(interval(tried).alias("i")).agg(
            F.sum("_size").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")
        ).collect()
        held = {r.i: (r.n, _joined(*r.a), _joined(*r.b)) for r in counted}
        ends, below = [(first, 0)], 0
        for i, probe in enumerate(tried):
            below += held.get(i, (0,))[0]
            ends.append((probe, below))
        ends.append((last + 1, whole.n))
        for b in open_ones:
            inside = [e for e in ends if b.low <= e[0] <= b.high]
            b.low, b.below_low = max((e for e in inside if e[1] <= b.target), default=(b.low, b.below_low))
            b.high, b.below_high = min((e for e in inside if e[1] >= b.target and e[0] > b.low), default=(b.high, b.below_high))
            # No row lies between an end and the nearest key inside.
            some = held.get(bisect.bisect_right(tried, b.low))
            if some and b.below_high - b.below_low == some[0]:
                b.low, b.high = max(b.low, some[1]), min(b.high, some[2] + 1)
            b.settle(allowed)
    return [b.border for b in brackets]


def sharded(
    docs: DataFrame, shards: int, tolerance: float = TOLERANCE, doc_id: str = "doc_id", text: str = "text",
    overhead: int = 8,
) -> DataFrame:
    """``(doc_id, text, size, shard, slot)``: every row in one of ``shards`` shards.

    ``size`` is the text's bytes plus ``overhead`` (a null text has none). The bytes
    of two shards differ by at most twice the tolerance, and what one row and the
    rows equal to it in text and id weigh. ``slot`` counts the rows of a shard from
    0 in the order of text hash and id. A null id sorts first among equal texts.
    No rows give no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumns({
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead,
        "_high": F.xxhash64("text"),
        "_low": F.coalesce(F.col("doc_id"), F.lit(-HALF).cast("long")),
    })
    keys = written(rows.select("_high", "_low", F.col("size").alias("_size")), "shard-keys")
    placed = rows.withColumn("shard", interval(borders(keys, shards, tolerance)))
    ranked = numbered(placed, "shard", ["_high", "_low"], "shards", compression="zstd")
    return ranked.select("doc_id", "text", "size", "shard", F.col("rank").alias("slot"))
