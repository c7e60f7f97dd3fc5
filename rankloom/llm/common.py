"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.session import written

# ---- fixed values -------------------------------------------------------
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
# ---- end of fixed values ------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_bucket(key: Column, modulus: int, remainder: int) -> Column:
    """Whether ``crc32`` of the key as text leaves this remainder; a null key
    counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus == remainder


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space; none for null."""
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>")
    )


def mapped(
    df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict | None], part_bytes: int = 1 << 23
) -> DataFrame:
    """``fn`` over record batches of at most about ``part_bytes`` (single longer
    rows come alone); it returns the columns of ``schema`` by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, part_bytes):
                out = fn(part)
                if out is not None:
                    columns = [
                        out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type)
                        for f in arrow
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def folded(
    df: DataFrame, schema: str, add: Callable[[object, pa.RecordBatch], object], finish: Callable[[object], dict],
    part_bytes: int = 1 << 23,
) -> DataFrame:
    """One result for each partition with rows: ``add(total, batch)`` over its batches,
    beginning with None, then ``finish(total)`` as columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in parts(batch, part_bytes):
                total = add(total, part)
        if total is not None:
            out = finish(total)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most about ``part_bytes``."""
    if batch.num_rows:
        step = max(1, batch.num_rows * part_bytes // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of some texts with A-Z lower-cased, the number of the
    word at each place, and the places where each text begins and the last ends.
    Words are runs without ASCII white space; a null text has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    if "" in words:  # before leading and after trailing white space
        none = words.index("")
        real = word != none
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        word = word[real]
        word -= word > none
        del words[none]
    return words, word, offsets


_kept: dict[str, object] = {}


def once(key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in this Python worker for a key; the one
    before the last leaves."""
    if key not in _kept:
        while len(_kept) >= 2:
            _kept.pop(next(iter(_kept)))
        _kept[key] = make()
    return _kept[key]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of the highest counts: all from the lowest count on that leaves at
    most ``most`` rows. Counted by the count's leading bits, so the driver sees a
    few hundred rows and nothing is sorted."""
    scale = F.floor(F.log2(F.col(n)) * 64)
    sizes = counts.where(F.col(n) > 0).groupBy(scale.alias("s")).agg(F.count(F.lit(1)).alias("rows")).collect()
    total, least = 0, None
    for s, rows in sorted(sizes, reverse=True):
        total += rows
        if total > most:
            break
        least = s
    return counts.where((F.col(n) > 0) & (scale >= least) if least is not None else F.lit(False))


def numbered(df: DataFrame, group: str, order: list[str], name: str, **options: str) -> DataFrame:
    """``df`` with ``rank`` (0, 1, ... in ``order`` within the group), no window over
    a group's rows: exchanged by range, stored sorted (with the writer's
    ``options``), and counted per partition."""
    at = written(
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)),
        name, **options,
    )
    # One row per partition, and one more for each further group in it.
    edges = at.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    edges = written(edges.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), "_first", "_before"), f"{name}-edges")
    return (
        at.join(edges, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_p")))
        .withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_at", "_part", "_p", "_group", "_first", "_before")
    )
