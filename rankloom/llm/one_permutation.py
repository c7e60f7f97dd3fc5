"""Near-duplicates by one-permutation MinHash with optimal densification.

One hash of each different word shingle serves all bins: its leading bits choose a
bin, the smallest hash of a bin is the bin's value. An empty bin takes the value of
a bin drawn for it, drawing again until that one is filled; the draws depend on
the bin alone, so two sets agree in a bin with a probability equal to their likeness.

Equal sets are one class from the start. Classes that agree in a whole band of
bins share a bucket. The candidates of a bucket are a star: the class with the most
fellows in all its buckets against the others, not every pair, and links are
confirmed on the full sets. Where a bucket then still holds several components, its
next class is the centre of a star over those not joined with it, round by round,
until a round has joined nothing or no bucket is open. Every round is linear in the
members of open buckets. Where buckets are open then, all their pairs of different
components are compared, so that no link is left out: those of a bucket of at most
``LARGE`` classes one by one, at most half as many a class, those of larger ones
block by block, as matrices and without a row for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import mapped, split_words
from rankloom.llm.simhash import components
from rankloom.session import written

SHINGLE = 4
PERCENT = 80
BINS = 512
BAND = 8
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
DRAWS = 1 << 12
LARGE = 32
BLOCK = 256

# ---- hashes of one batch of texts -----------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sequence(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of sequences, given their parts' hashes by place."""
    h = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for part in parts:
        h = mix(h + part)
    return h


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text in rising order, end to end, and
    where each text's begin and the last ends."""
    words, word, offsets = split_words(texts)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w.encode()) for w in words), dtype=np.uint64, count=len(words))[word]
    count = np.diff(offsets)
    doc = np.repeat(np.arange(len(count)), np.maximum(count - size + 1, 0))
    first = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(count - size + 1, 0)), np.maximum(count - size + 1, 0))
    start = first + offsets[1:][doc] - size + 1
    found, owner = [_sequence([hashes[start + k] for k in range(size)])], [doc]
    for n in range(1, size):  # fewer words: the whole sequence
        short = np.flatnonzero(count == n)
        found.append(_sequence([hashes[offsets[short] + k] for k in range(n)]))
        owner.append(short)
    h, doc = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


def signatures(h: np.ndarray, edges: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of bin values for each set; sets without an element are left empty."""
    n = len(edges) - 1
    doc = np.repeat(np.arange(n), np.diff(edges))
    bin_no = (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    place = doc * bins + bin_no
    least = np.ones(len(h), dtype=bool)
    least[1:] = place[1:] != place[:-1]  # hashes rise within a set
    values = np.full(n * bins, EMPTY)
    filled = np.zeros(n * bins, dtype=bool)
    values[place[least]], filled[place[least]] = h[least], True
    open_places = np.flatnonzero(~filled & np.repeat(np.diff(edges) > 0, bins))
    for draw in range(DRAWS):
        if not len(open_places):
            break
        own = open_places % bins
        drawn = mix((own + (draw + 1) * bins).astype(np.uint64)) >> np.uint64(64 - bins.bit_length() + 1)
        source = open_places - own + drawn.astype(np.int64)
        hit = filled[source]
        values[open_places[hit]] = values[source[hit]]
        open_places = open_places[~hit]
    for at in open_places:  # hardly ever: the next filled bin
        row = filled[at - at % bins : at - at % bins + bins]
        steps = np.flatnonzero(np.roll(row, -(at % bins)))
        values[at] = values[at - at % bins + (at % bins + steps[0]) % bins]
    return values.reshape(n, bins)


def bands(signature: np.ndarray, rows: int = BAND) -> np.ndarray:
    """A hash for each run of ``rows`` bins, told apart by its place."""
    n, bins = signature.shape
    runs = signature.reshape(n * (bins // rows), rows)
    place = np.tile(np.arange(bins // rows, dtype=np.uint64), n)
    return _sequence([place, *runs.T]).reshape(n, bins // rows)


# ---- tables ---------------------------------------------------------------


def prints(docs: DataFrame, doc_id: str, text: str, size: int, bins: int, band: int) -> DataFrame:
    """``(doc_id, text_hash, c1, c2, n_shingles, keys)`` per row: ``c1, c2`` are equal for
    equal sets, ``keys`` name the buckets."""
    def batch(rows: pa.RecordBatch) -> dict:
        h, edges = shingle_sets(rows.column("text"), size)
        doc = np.repeat(np.arange(rows.num_rows), np.diff(edges))
        # Sums of two independent mixes of the elements.
        totals = np.zeros((2, rows.num_rows), dtype=np.uint64)
        for total, salt in zip(totals, (0, 0x9E3779B97F4A7C15), strict=True):
            np.add.at(total, doc, mix(mix(h ^ np.uint64(salt)) + np.uint64(salt)))
        keys = bands(signatures(h, edges, bins), band).view(np.int64)
        some = np.diff(edges) > 0
        ends = np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32)
        return {
            "doc_id": rows.column("doc_id"), "text_hash": rows.column("text_hash"),
            "c1": totals[0].view(np.int64), "c2": totals[1].view(np.int64), "n_shingles": np.diff(edges),
            "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel())),
        }

    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")
    )
    schema = "doc_id long, text_hash long, c1 long, c2 long, n_shingles long, keys array<long>"
    return mapped(narrow, schema, batch, 1 << 22)


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``(label, n, s)``: the sorted shingle hashes of the texts that ``wanted``
    (``label, _id, _hash``) names."""
    def batch(rows: pa.RecordBatch) -> dict:
        h, edges = shingle_sets(rows.column("text"), size)
        data = h.astype("<u8").tobytes()
        return {
            "label": rows.column("label"), "n": np.diff(edges),
            "s": [data[8 * a : 8 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)],
        }

    keyed = docs.select(_id(F.col(doc_id)).alias("_id"), F.xxhash64(F.col(text)).alias("_hash"), F.col(text).alias("text"))
    # One plan at every size. A row that is repeated leaves once, before its set is made.
    found = keyed.join(wanted.hint("merge"), ["_id", "_hash"]).dropDuplicates(["_id", "_hash"])
    return mapped(found.select("label", "text"), "label long, n long, s binary", batch, 1 << 22)


def _id(column):
    return F.coalesce(column.cast("long"), F.lit(-(1 << 63)).cast("long"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` whose full sets have the likeness."""
    def batch(rows: pa.RecordBatch) -> dict:
        linked = []
        for sa, sb in zip(rows.column("sa"), rows.column("sb"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), dtype="<u8") for s in (sa, sb))
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            shared = int((y[at] == x).sum())
            linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return {"a": rows.column("a"), "b": rows.column("b"), "linked": linked}

    one = sets.select(F.col("label").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    two = sets.select(F.col("label").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    both = pairs.join(one, "b").join(two, "a")
    return mapped(both.select("a", "b", "sa", "sb"), "a long, b long, linked boolean", batch, 1 << 24)


def stars(buckets: DataFrame) -> DataFrame:
    """``(key, centre, of, size)`` of each bucket with several components: the class
    with the most fellows in all buckets, its root and its set's size."""
    best = buckets.groupBy("key").agg(
        F.max(F.struct("degree", "label", "root", "n")).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")
    )
    return best.where("lo <> hi").select(
        "key", F.col("c.label").alias("centre"), F.col("c.root").alias("of"), F.col("c.n").alias("size")
    )


def left_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: the pairs of a bucket's classes in different components, of sizes
    that can have the likeness."""
    one = buckets.select("key", F.col("label").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    two = buckets.select("key", F.col("label").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    return two.join(one, "key").where("a > b and ra <> rb").where(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    ).select("a", "b").distinct()


def shared_sizes(one: list[np.ndarray], two: list[np.ndarray], width: int = 1 << 13) -> np.ndarray:
    """How many elements each of some sorted sets shares with each of others."""
    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (x, row), (y, column) = flat(one), flat(two)
    both = np.intersect1d(x, y)
    shared = np.zeros((len(one), len(two)), dtype=np.int64)
    for start in range(0, len(both), width):
        part = both[start : start + width]

        def present(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            matrix = np.zeros((rows, len(part)), dtype=np.float32)
            matrix[owner[hit], at[hit]] = 1
            return matrix

        # Exact: at most ``width`` ones are added.
        shared += (present(x, row, len(one)) @ present(y, column, len(two)).T).astype(np.int64)
    return shared


def cell_links(cell: pa.Table, percent: int) -> pa.Table:
    """``(a, b)``: the links between the two blocks of a cell, of classes that share a
    bucket and lie in different components."""
    labels, roots, sizes, blocks = (cell.column(c).to_numpy() for c in ("label", "root", "n", "block"))
    low, high = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    fellows = np.zeros((len(low), len(high)), dtype=bool)
    keys = cell.column("keys").combine_chunks()
    key, owner = keys.flatten().to_numpy(), np.repeat(np.arange(len(labels)), keys.value_lengths().to_numpy())
    row, column = np.full(len(labels), -1), np.full(len(labels), -1)
    row[low], column[high] = np.arange(len(low)), np.arange(len(high))
    order = np.argsort(key, kind="stable")
    for bearers in np.split(owner[order], np.flatnonzero(np.diff(key[order])) + 1):
        rows, columns = row[bearers], column[bearers]
        fellows[np.ix_(rows[rows >= 0], columns[columns >= 0])] = True
    sets = [np.frombuffer(s.as_buffer(), dtype="<u8") for s in cell.column("s")]
    shared = shared_sizes([sets[i] for i in low], [sets[i] for i in high])
    either = sizes[low][:, None] + sizes[high][None, :] - shared
    fellows &= (roots[low][:, None] != roots[high][None, :]) & (100 * shared >= percent * either)
    i, j = np.nonzero(fellows)
    one, two = labels[low[i]], labels[high[j]]
    return pa.table({"a": np.maximum(one, two), "b": np.minimum(one, two)})


def family_links(buckets: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: the links that ``left_pairs`` would lead to, without its pairs.

    Classes that buckets tie together are a family, dealt to blocks of about ``block``
    classes. Every two blocks meet in a cell, which compares them as a matrix: a class goes
    once to each block of its family, and a task holds two blocks at a time."""
    least = buckets.groupBy("key").agg(F.min("label").alias("b"))
    ties = buckets.join(least, "key").select(F.col("label").alias("a"), "b").distinct()
    nodes = buckets.select(F.col("label").alias("fingerprint"), "label").distinct()
    family = components(nodes, ties).select(F.col("fingerprint").alias("label"), F.col("root").alias("family"))
    members = buckets.groupBy("label", "n", "root").agg(F.collect_list("key").alias("keys"))
    members = written(members.join(family, "label"), "minhash-members")
    blocks = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("label"), "blocks"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = met.join(sets.select("label", "s"), "label").select(
        "family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "label", "root", "n", "block", "keys", "s",
    )
    links = cells.groupBy("family", "low", "high").applyInArrow(lambda cell: cell_links(cell, percent), "a long, b long")
    return links.where("a <> b").distinct()


def linked_classes(
    classes: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int
) -> DataFrame | None:
    """``(label, root)`` of the classes that are linked with others; None if there are none."""
    entries = classes.select("label", "n", F.explode("keys").alias("key"))
    fellows = entries.groupBy("key").agg(F.count(F.lit(1)).alias("fellows")).where("fellows > 1")
    shared = written(entries.join(written(fellows, "minhash-fellows"), "key"), "minhash-shared")
    degree = written(shared.groupBy("label").agg(F.sum("fellows").alias("degree")), "minhash-degrees")
    buckets = shared.drop("fellows").join(degree, "label").withColumn("root", F.col("label"))
    wanted = classes.join(degree, "label", "left_semi").select("label", "_id", "_hash")
    sets = written(full_sets(docs, written(wanted, "minhash-wanted"), doc_id, text, size), "minhash-sets")
    checked, roots, last = None, None, False
    while True:
        centres = written(stars(buckets), "minhash-centres")
        if centres.isEmpty():
            return roots
        open_buckets = buckets.join(centres, "key")
        if last:
            open_buckets = written(open_buckets, "minhash-open")
            large = open_buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > LARGE)
            large = written(large.select("key"), "minhash-large")
            pairs = left_pairs(open_buckets.join(large, "key", "left_anti"), percent)
        else:
            pairs = open_buckets.where("root <> of").where(
                100 * F.least("n", "size") >= percent * F.greatest("n", "size")
            ).select(F.greatest("label", "centre").alias("a"), F.least("label", "centre").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        verdicts = written(confirmed(written(pairs, "minhash-pairs"), sets, percent), "minhash-checked")
        if last and not large.isEmpty():
            families = written(open_buckets.join(large, "key", "left_semi"), "minhash-families")
            links = family_links(families, sets, percent)
            verdicts = verdicts.union(written(links.withColumn("linked", F.lit(True)), "minhash-family-links"))
        checked = verdicts if checked is None else checked.union(verdicts)
        joined = not verdicts.where("linked").isEmpty()
        if joined:
            links = checked.where("linked").select("a", "b")
            nodes = links.select(F.explode(F.array("a", "b")).alias("label")).distinct()
            found = components(nodes.select(F.col("label").alias("fingerprint"), "label"), links)
            roots = written(found.select(F.col("fingerprint").alias("label"), "root"), "minhash-roots")
        if last:
            return roots
        last = not joined
        # A centre was compared with all of its bucket, so it leaves it.
        left = open_buckets.where("label <> centre").select("key", "label", "n", "degree", "root")
        if joined:
            left = left.drop("root").join(roots, "label", "left").withColumn("root", F.coalesce("root", "label"))
        buckets = written(left, "minhash-left")


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bins: int = BINS, band: int = BAND,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id, kept)``: one row per input row.

    Two texts are linked where ``100 * |intersection| >= percent * |union|`` of their
    sets of ``size``-word shingles (fewer words: the whole sequence is the one
    shingle). ``component_id`` is the smallest id reachable. Null and empty texts and
    those without a word have no shingle and are linked with nothing, not with
    each other either. Repeated rows stay and agree. A row without id links others
    but gives no id to a component; one of such rows alone has a null
    ``component_id`` and is kept. No rows give no rows.

    Links are exact on what is compared: shingles count as equal where 64 bits of
    hash are. A pair of likeness 0.8 fails to share one of its 64 buckets
    with probability (1 - 0.8^8)^64, 8 in a million. ``bins`` must be a power of two and a
    multiple of ``band``.
    """
    if bins & (bins - 1) or bins % band:
        raise ValueError("bins must be a power of two and a multiple of band")
    rows = written(prints(docs, doc_id, text, size, bins, band), "minhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = rows.where("n_shingles > 0").groupBy("c1", "c2").agg(
        first.alias("f"), F.max("n_shingles").alias("n"), F.any_value("keys").alias("keys")
    )
    classes = written(
        classes.select(
            F.monotonically_increasing_id().alias("label"), "c1", "c2", "n", "keys",
            F.col("f.doc_id").alias("least"), _id(F.col("f.doc_id")).alias("_id"), F.col("f.text_hash").alias("_hash"),
        ),
        "minhash-classes",
    )
    roots = linked_classes(classes, docs, doc_id, text, size, percent)
    named = classes.select("label", "c1", "c2", "least")
    if roots is None:
        named = named.withColumn("component_id", F.col("least"))
    else:
        whole = named.join(roots, "label", "left").withColumn("root", F.coalesce("root", "label"))
        smallest = whole.groupBy("root").agg(F.min("least").alias("component_id"))
        named = whole.join(written(smallest, "minhash-components"), "root")
    found = rows.join(written(named.select("c1", "c2", "component_id"), "minhash-named"), ["c1", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
