"""SimHash near-duplicates through one-bit neighbours.

A fingerprint names itself and each of the 64 values that are one flipped bit away.
Two fingerprints that differ in one or two bits have a name in common, and two that
have one differ in two bits at most, so the bearers of a name are linked in a chain
in their order. A name is borne by 65 different fingerprints at most: the work and
the links are linear in the fingerprints, however large a group of near copies is,
and no link is lost. Exact copies share a fingerprint and enter as one.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import mapped, texts_of
from rankloom.session import written

SEED = 42
CHUNK = 1 << 16
FLIPS = [0, *[1 << k for k in range(64)]]


def fingerprint_of(text: bytes, shingle: int) -> int:
    """64-bit SimHash of one text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    total, n = np.zeros(64, dtype=np.int64), 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    grams = iter(grams)
    while chunk := list(map(digest, itertools.islice(grams, CHUNK))):
        rows = np.array(chunk, dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(chunk)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fingerprint)``, all long, one row per input row; a
    null text is empty."""
    def batch(rows: pa.RecordBatch) -> dict:
        return {
            "doc_id": rows.column("doc_id"),
            "text_hash": rows.column("text_hash"),
            "fingerprint": [fingerprint_of(t, shingle) for t in texts_of(rows)],
        }

    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")
    )
    return mapped(narrow, "doc_id long, text_hash long, fingerprint long", batch)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, bits: int = 2, longest: int = 64) -> DataFrame:
    """``(a, b)`` over distinct fingerprints, whose components are those of all
    pairs at most ``bits`` apart: a chain through the bearers of each name.
    ``longest`` is the limit of an earlier form's lists and changes nothing."""
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    # At distance 2 either is the other's one-bit neighbour's neighbour. At
    # distance 1 they agree but for one bit, which is masked.
    if bits == 2:
        names = [F.col("fingerprint").bitwiseXOR(F.lit(_signed(f)).cast("long")) for f in FLIPS]
    else:
        names = [F.col("fingerprint").bitwiseAND(F.lit(_signed(~f % (1 << 64))).cast("long")) for f in FLIPS[1:]]
    borne = prints.where(F.lit(bits > 0)).select(
        F.posexplode(F.array(*names)).alias("bit", "name"), F.col("fingerprint").alias("b")
    )
    # The window holds a name's bearers: 65 at most.
    bearers = Window.partitionBy(*(["name"] if bits == 2 else ["bit", "name"])).orderBy("b")
    chains = borne.withColumn("a", F.lag("b").over(bearers)).where("a is not null")
    return chains.select("a", "b").distinct()


def components(prints: DataFrame, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(fingerprint, root)``: the smallest label reachable over the edges.

    ``prints`` has ``(fingerprint, label)`` with distinct labels. Large-star and
    small-star steps in turn shrink the edges to stars in about log(n) rounds. The
    minima merge map-side and are stored, so that a hub's joins can be split.
    """
    spark = prints.sparkSession
    label = prints.select("fingerprint", "label")
    e = edges.select("a", "b")
    e = e.join(label.toDF("a", "u"), "a").join(label.toDF("b", "v"), "b").select("u", "v")
    e = written(e.where("u <> v"), "simhash-edges")
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        lowest = written(lowest, "simhash-lowest")
        # Large star: neighbours above a node are tied to its smallest neighbour.
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: a node and its lower neighbours are tied to the lowest.
        large = written(large, "simhash-large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = written(down.groupBy("u").agg(F.min("v").alias("m")), "simhash-least")
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "simhash-edges")
        after = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        e = now
        if before == after:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("u").alias("label"), F.col("v").alias("root"))
    return prints.join(roots, "label", "left").select("fingerprint", F.coalesce("root", "label").alias("root"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    bits: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    longest: int = 64,
) -> DataFrame:
    """``(doc_id, text_hash, fingerprint, group, component_id)``, all long: one row
    per input row, ``group`` being the same for all that are linked.

    ``component_id`` is the smallest ``doc_id`` reachable over fingerprints at
    most ``bits`` apart. Null and empty texts, and those without a word, have
    fingerprint zero and link as any other. Repeated rows stay and agree. A row
    without ``doc_id`` links others, but never gives its id to a group; a group
    of such rows alone has a null ``component_id``. No rows give no rows.
    """
    prints = written(fingerprints(docs, shingle, doc_id, text), "simhash")
    # Labels must be distinct and total: rank by smallest id, those without any by fingerprint.
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-classes")
    nodes = classes.select("fingerprint", F.col("fingerprint").alias("label"))
    roots = components(nodes, links(classes.select("fingerprint"), bits, longest))
    smallest = (
        roots.join(classes, "fingerprint").groupBy("root").agg(F.min("least").alias("component_id"))
    )
    whole = roots.join(smallest, "root").select("fingerprint", F.col("root").alias("group"), "component_id")
    return prints.join(whole, "fingerprint").select("doc_id", "text_hash", "fingerprint", "group", "component_id")


def survivors(docs: DataFrame, shingle: int = 3, bits: int = 2, longest: int = 64) -> DataFrame:
    """Of each group of near copies one row of ``docs``, with its own columns: the
    one of the smallest ``doc_id`` (a null one comes last, ties go by the hash of
    the text, rows equal in both are one)."""
    found = near_duplicates(docs, shingle, bits, longest=longest)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    none = F.lit(-(1 << 63)).cast("long")
    chosen = found.groupBy("group").agg(first.alias("f")).select(
        F.coalesce("f.doc_id", none).alias("_id"), F.col("f.text_hash").alias("_hash")
    )
    # The join and the removal of equal rows share the keys, so texts move once.
    # The row itself is one column, whatever its columns are called.
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), none).alias("_id"), F.xxhash64("text").alias("_hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )
    kept = keyed.join(written(chosen, "simhash-survivors"), ["_id", "_hash"], "left_semi")
    return kept.dropDuplicates(["_id", "_hash"]).select("_row.*")
