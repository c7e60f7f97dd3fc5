"""Texts coded in blocks, and what is known of words brought to them.

A block holds some rows' tokens as places in a list of its different words. It asks once
for each of them, whatever number of its rows has the word, so that only the words of
blocks are exchanged, and a block as one row of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from rankloom.session import written

PART_BYTES = 1 << 23
BLOCK_BYTES = 1 << 24
BLOCKS_PER_FILE = 4


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed planes of bytes."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = pa.decompress(data[9:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(f"<u{width}")[:, 0].astype(np.int64)


def one_list(values: pa.Array) -> pa.Array:
    """A list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def coded(docs: DataFrame, tokens: Column, block_bytes: int | None = None) -> DataFrame:
    """The tokens of all rows, stored in blocks: ``ids`` of the rows, the ``sizes`` of their
    token lists, and the tokens themselves as ``codes``, places in the block's ``words``. Of
    each word ``rows`` is the number of rows it is in, ``begins`` that of the word pairs it
    begins, null for a word that is in no pair."""
    most = BLOCK_BYTES if block_bytes is None else block_bytes
    rows = docs.select("doc_id", tokens.alias("t"))
    schema = StructType([
        StructField("block", LongType()),
        StructField("ids", ArrayType(rows.schema["doc_id"].dataType)),
        StructField("sizes", BinaryType()),
        StructField("codes", BinaryType()),
        StructField("words", ArrayType(StringType())),
        StructField("rows", ArrayType(LongType())),
        StructField("begins", ArrayType(LongType())),
    ])
    arrow = to_arrow_schema(schema)

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = pa.concat_arrays(table["t"].chunks)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n, row = len(words.dictionary), np.repeat(np.arange(len(sizes)), sizes)
        whole = row[1:] == row[:-1]
        begins = np.bincount(codes[:-1][whole], minlength=n)
        alone = begins + np.bincount(codes[1:][whole], minlength=n) == 0
        columns = [
            pa.array([number]), one_list(pa.concat_arrays(table["doc_id"].chunks)), pa.array([packed(sizes)]), pa.array([packed(codes)]),
            one_list(words.dictionary), one_list(pa.array(np.bincount(np.unique(row * max(1, n) + codes) % max(1, n), minlength=n))),
            one_list(pa.array(begins, mask=alone)),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                if held and size + piece.nbytes > most:
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
                held.append(piece)
                size += piece.nbytes
        if held:
            yield block(number, held)

    # Few to a file: a reader takes all rows of a file's only row group at once.
    return written(rows.mapInArrow(run, schema), "coded-texts", compression="zstd", maxRecordsPerFile=str(BLOCKS_PER_FILE))


def of_words(blocks: DataFrame, *values: str) -> DataFrame:
    """``(block, place, word)`` and the values of each different word of a block."""
    zipped = F.arrays_zip("words", *values)
    return blocks.select("block", F.posexplode(zipped).alias("place", "_w")).select(
        "block", "place", F.col("_w.words").alias("word"), *[F.col(f"_w.{v}").alias(v) for v in values]
    )


def answered(blocks: DataFrame, answers: DataFrame, fn: Callable[[dict, pa.Table], Iterable], schema: StructType) -> DataFrame:
    """``fn(block, answers)`` for each block, a row, and what was found for its words or pairs."""
    arrow = to_arrow_schema(schema)

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        columns = fn({c: block[c][0] for c in block.column_names}, found)
        return pa.table([pa.array(c, f.type) if isinstance(c, list | np.ndarray) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    named = answers.withColumnRenamed("block", "_block")
    return blocks.groupBy("block").cogroup(named.groupBy("_block")).applyInArrow(run, schema)


def row_of_each(block: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """For each token of a block its row and its code, and the number of rows."""
    sizes = unpacked(block["sizes"].as_py())
    return np.repeat(np.arange(len(sizes)), sizes), unpacked(block["codes"].as_py()), len(sizes)
