"""Term weights, perplexity and repetition per document.

Terms and word pairs are counted inside the row, so no text is ever exchanged, only
counts. A term that occurs in a large share of the documents only adds rows to a
side that the adaptive skew join can split. ``doc_id`` names one document: rows that
share it are not added up.

A corpus measured by its own counts is coded in blocks of texts (``blocks``): a block asks
once for each of its different words, and once for each of its different word pairs, and
no row is exchanged for a pair or term of one document.

The counts of a corpus are models of their own, saved as tables: they can be loaded,
merged with those of further documents, and applied to texts they were not taken from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from rankloom.operators.blocks import answered, coded, of_words, one_list, packed, row_of_each, unpacked
from rankloom.operators.hot_groups import ranked
from rankloom.session import freeing, new_table_path, written

# ---- fixed values -------------------------------------------------------
TERM = r"[\p{L}\p{N}_]{2,}"
STUFFED_WEIGHT = 0.1
PERPLEXITY_LIMIT = 40.0
SMOOTHING = 0.1
SHINGLE = 3
PART_BYTES = 1 << 23
PAIR_PARTS = 512
# ---- end of fixed values ------------------------------------------------


def terms(text: Column) -> Column:
    """Lower-case runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def counted(items: Column) -> Column:
    """``(item, n)`` of each different item of a list: sorted, then the lengths of the
    runs of equal ones."""
    def runs(s: Column) -> Column:
        places = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull()
        )
        both = F.transform(F.array(places), lambda at: F.transform(
            at, lambda i, k: F.struct(F.get(s, i).alias("item"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n"))
        ))
        return F.element_at(both, 1)

    # One-element transforms bind a list once for its several uses.
    return F.element_at(F.transform(F.array(F.sort_array(items)), runs), 1)


def counted_rows(docs: DataFrame, tokens: Column, width: int, names: Sequence[str]) -> DataFrame:
    """``(doc_id, *names, n)``: each row's different runs of ``width`` tokens (one or two)
    and how often they occur in it, counted as numbers in the tasks that hold the texts."""
    rows = docs.select("doc_id", tokens.alias("t")).where("doc_id is not null")
    words = [StructField(name, StringType()) for name in names[:-1]]
    schema = StructType([rows.schema["doc_id"], *words, StructField(names[-1], LongType())])
    arrow = to_arrow_schema(schema)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lists = batch.column("t")
        coded = lists.flatten().dictionary_encode()
        token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)
        size = max(1, len(coded.dictionary))
        if width == 2:
            whole = row[1:] == row[:-1]
            row, token = row[:-1][whole], (token[:-1] * size + token[1:])[whole]
        if not len(row):
            return None
        order = np.argsort(token, kind="stable")
        order = order[np.argsort(row[order], kind="stable")]
        row, token = row[order], token[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (token[1:] != token[:-1])]))
        n, token = np.diff(np.append(first, len(row))), token[first]
        item = [token // size, token % size] if width == 2 else [token]
        columns = [batch.column("doc_id").take(pa.array(row[first])), *[coded.dictionary.take(pa.array(i)) for i in item], pa.array(n)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                found = part(batch.slice(start, step))
                if found is not None:
                    yield found

    return rows.mapInArrow(run, schema)


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, term, tf)``; the rows stay where the texts are."""
    return counted_rows(docs, terms(F.col(text)), 1, ("term", "tf"))


def coded_texts(docs: DataFrame, text: str = "text", max_tokens: int | None = None) -> DataFrame:
    """``coded`` blocks of the terms of texts, of each text at most the first ``max_tokens``."""
    tokens = terms(F.col(text))
    return coded(docs.where("doc_id is not null"), tokens if max_tokens is None else F.slice(tokens, 1, max_tokens))


class TermModel:
    """Document frequencies of a corpus, saved below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def _saved(cls, spark: SparkSession, frequencies: DataFrame, documents: DataFrame, path: str | None) -> TermModel:
        path = path or new_table_path(spark, "term-model")
        with freeing(spark):
            frequencies.write.parquet(f"{path}/terms")
            documents.write.parquet(f"{path}/documents")
        return cls(spark, path)

    @classmethod
    def of_counts(cls, docs: DataFrame, counts: DataFrame, path: str | None = None) -> TermModel:
        frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return cls._saved(docs.sparkSession, frequency, docs.agg(F.count(F.lit(1)).alias("n")), path)

    @classmethod
    def of_blocks(cls, docs: DataFrame, blocks: DataFrame, path: str | None = None) -> TermModel:
        frequency = of_words(blocks, "rows").groupBy(F.col("word").alias("term")).agg(F.sum("rows").alias("df"))
        return cls._saved(docs.sparkSession, frequency, docs.agg(F.count(F.lit(1)).alias("n")), path)

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", path: str | None = None) -> TermModel:
        return cls.of_counts(docs, term_counts(docs, text), path)

    def frequencies(self) -> DataFrame:
        """``(term, df)``."""
        return self.spark.read.schema("term string, df bigint").parquet(f"{self.path}/terms")

    def documents(self) -> DataFrame:
        """One row: the number ``n`` of documents."""
        return self.spark.read.schema("n bigint").parquet(f"{self.path}/documents")

    def merged(self, other: TermModel, path: str | None = None) -> TermModel:
        """The model of both corpora, which share no document."""
        frequency = self.frequencies().union(other.frequencies()).groupBy("term").agg(F.sum("df").alias("df"))
        size = self.documents().union(other.documents()).agg(F.sum("n").alias("n"))
        return self._saved(self.spark, frequency, size, path)

    def weights(self) -> DataFrame:
        """``(term, idf)``."""
        n = self.documents().scalar()
        return self.frequencies().select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(
    docs: DataFrame, text: str = "text", model: TermModel | None = None, blocks: DataFrame | None = None
) -> DataFrame:
    """Unit-length weights ``tf * (ln((1+n)/(1+df)) + 1)`` per document and term.

    ``model`` holds the document frequencies, by default those of the documents
    themselves; terms it lacks are left out. ``blocks`` are the texts as ``coded_texts``
    gives them, by default made here.
    """
    # Stored: the texts are read once, and a block asks once for each of its words.
    blocks = coded_texts(docs, text) if blocks is None else blocks
    model = model or TermModel.of_blocks(docs, blocks)
    # Stored: what this join takes on disk is gone when the blocks are exchanged.
    idf = of_words(blocks).join(model.weights(), F.col("word") == F.col("term")).select("block", "place", "idf")
    idf = written(idf, "known-terms", compression="zstd")
    item = StructType([StructField("term", StringType()), StructField("raw", DoubleType())])
    schema = StructType([
        StructField("doc_id", blocks.schema["ids"].dataType.elementType),
        StructField("square", DoubleType()),
        StructField("items", ArrayType(item)),
    ])

    def weighed(block: dict, found: pa.Table):
        row, code, n = row_of_each(block)
        words = block["words"].values
        weight = np.full(len(words) + 1, np.nan)
        weight[found["place"].to_numpy()] = found["idf"].to_numpy()
        each, tf = np.unique(row * len(weight) + code, return_counts=True)
        row, code = each // len(weight), each % len(weight)
        known = ~np.isnan(weight[code])
        row, code, raw = row[known], code[known], tf[known] * weight[code[known]]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        items = pa.StructArray.from_arrays([words.take(pa.array(code)), pa.array(raw)], ["term", "raw"])
        return block["ids"].values, np.bincount(row, raw * raw, n).astype(float), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    rows = answered(blocks.select("block", "ids", "sizes", "codes", "words"), idf, weighed, schema)
    # The window holds the rows of one document, each with all its terms.
    length = F.sqrt(F.sum("square").over(Window.partitionBy("doc_id")))
    each = rows.withColumn("_length", length).select("doc_id", "_length", F.explode("items").alias("_i"))
    return each.select("doc_id", F.col("_i.term").alias("term"), (F.col("_i.raw") / F.col("_length")).alias("weight"))


def stuffing_flag(
    docs: DataFrame, weights: DataFrame, limit: float = STUFFED_WEIGHT
) -> DataFrame:
    """Suspicious when more than one term weighs more than the limit."""
    heavy = weights.groupBy("doc_id").agg(F.count_if(F.col("weight") > limit).alias("n"))
    return docs.select("doc_id").join(heavy, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("heavy_terms"),
        F.coalesce(F.col("n") > 1, F.lit(False)).alias("is_suspicious"),
    )


def pair_counts(docs: DataFrame, text: str = "text", max_tokens: int | None = None) -> DataFrame:
    """``(doc_id, w1, w2, n)``: each document's different word pairs; the rows stay
    where the texts are."""
    tokens = terms(F.col(text))
    if max_tokens is not None:
        tokens = F.slice(tokens, 1, max_tokens)
    return counted_rows(docs, tokens, 2, ("w1", "w2", "n"))


class PairModel:
    """Counts of a corpus's word pairs, saved below ``path``: add-k smoothed bigrams."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def _saved(cls, spark: SparkSession, pairs: DataFrame, path: str | None) -> PairModel:
        model = cls(spark, path or new_table_path(spark, "pair-model"))
        with freeing(spark):
            pairs.write.parquet(f"{model.path}/pairs")
        # By word: how many pairs it begins, 0 for one that only ends pairs.
        sides = F.array(*[
            F.struct(F.col(w).alias("w"), F.coalesce(c, F.lit(0).cast("long")).alias("c"))
            for w, c in (("w1", F.col("c12")), ("w2", F.lit(None).cast("long")))
        ])
        words = model.pairs().select(F.inline(sides)).groupBy("w").agg(F.sum("c").alias("c1"))
        with freeing(spark):
            words.write.parquet(f"{model.path}/words")
        return model

    @classmethod
    def of_counts(cls, counts: DataFrame, path: str | None = None) -> PairModel:
        pairs = counts.groupBy("w1", "w2").agg(F.sum("n").alias("c12"))
        return cls._saved(counts.sparkSession, pairs, path)

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", path: str | None = None) -> PairModel:
        return cls.of_counts(pair_counts(docs, text), path)

    def pairs(self) -> DataFrame:
        """``(w1, w2, c12)``."""
        return self.spark.read.schema("w1 string, w2 string, c12 bigint").parquet(f"{self.path}/pairs")

    def words(self) -> DataFrame:
        """``(w, c1)``."""
        return self.spark.read.schema("w string, c1 bigint").parquet(f"{self.path}/words")

    def merged(self, other: PairModel, path: str | None = None) -> PairModel:
        pairs = self.pairs().union(other.pairs()).groupBy("w1", "w2").agg(F.sum("c12").alias("c12"))
        return self._saved(self.spark, pairs, path)

    def scored(self, counts: DataFrame, smoothing: float = SMOOTHING, whole: bool = False) -> DataFrame:
        """``(doc_id, n, lp)`` of each row of ``counts``, ``lp`` the log probability of ``w2``
        after ``w1``. A pair that was not counted has 0 of its first word's, and after an
        uncounted word all counted words are equally likely. ``whole``: the model has
        counted every pair of ``counts``."""
        vocabulary = self.words().agg(F.count(F.lit(1)).alias("v")).scalar()
        first = self.words().withColumnRenamed("w", "w1")
        none = F.lit(0).cast("long")
        share = (F.coalesce("c12", none) + smoothing) / (F.coalesce("c1", none) + vocabulary * smoothing)
        # Pairs meet as 128 bits of hash, in place of two words; sorted by 64 of them only, which is a radix sort.
        def keyed(df: DataFrame, a: str, b: str) -> DataFrame:
            return df.withColumns({a: F.xxhash64("w1", "w2"), b: F.xxhash64(F.lit(1), "w2", "w1")})

        same = (F.col("a1") == F.col("b1")) & (F.col("a2").bitwiseXOR(F.col("b2")) == 0)
        if whole:
            known = keyed(self.pairs().join(first, "w1").withColumn("lp", F.log(share)), "b1", "b2").select("b1", "b2", "lp")
            return keyed(counts, "a1", "a2").select("doc_id", "n", "a1", "a2").join(known, same).select("doc_id", "n", "lp")
        known = keyed(self.pairs(), "b1", "b2").select("b1", "b2", "c12")
        both = keyed(counts, "a1", "a2").join(known, same, "left").join(first, "w1", "left")
        return both.select("doc_id", "n", F.log(share).alias("lp"))


def _own_scores(blocks: DataFrame, smoothing: float) -> DataFrame:
    """``(doc_id, ll, pairs)`` of each row with a word pair: the log likelihood of its pairs by
    the counts of all rows, and their number.

    Words are numbered, the most frequent first, and a pair is the number of its two words.
    A block sends its different pairs in ``PAIR_PARTS`` lists, each packed into one row, and
    gets a list of counts back for each."""
    spark = blocks.sparkSession
    counts = of_words(blocks, "begins").where("begins is not null").groupBy("word").agg(F.sum("begins").alias("c1"))
    order = F.struct((-F.col("c1")).alias("c"), F.col("word").alias("w"))
    words = written(ranked(counts.withColumn("_all", F.lit(0)), ["_all"], order).select("word", "c1", "rank"), "pair-words", compression="zstd")
    vocabulary = words.count()
    # Stored: what this join takes on disk is gone when the blocks are exchanged.
    known = written(of_words(blocks).join(words, "word").select("block", "place", "c1", "rank"), "known-words", compression="zstd")
    ids = blocks.schema["ids"].dataType
    schema = StructType([
        StructField("block", LongType()), StructField("part", IntegerType()), StructField("pairs", BinaryType()), StructField("n", BinaryType()),
        StructField("ids", ids), StructField("sizes", BinaryType()), StructField("places", BinaryType()), StructField("base", ArrayType(DoubleType())),
    ])
    across = vocabulary // PAIR_PARTS + 1
    span = (vocabulary + 1) * across

    def numbered(block: dict, found: pa.Table):
        row, code, n = row_of_each(block)
        size = len(block["words"].values) + 1
        number, begins = np.zeros(size, np.int64), np.zeros(size, np.int64)
        number[found["place"].to_numpy()] = found["rank"].to_numpy()
        begins[found["place"].to_numpy()] = found["c1"].to_numpy()
        whole = row[1:] == row[:-1]
        row, first, second = row[:-1][whole], code[:-1][whole], number[code[1:][whole]]
        base = np.bincount(row, np.log(begins + vocabulary * smoothing)[first], n)
        first = number[first]
        # The part follows from both words, so that no word fills one; it leaves a 512th of the second.
        each = (first + second) % PAIR_PARTS * span + first * across + second // PAIR_PARTS
        each, places, n_each = np.unique(each, return_inverse=True, return_counts=True)
        edges = np.searchsorted(each, np.arange(PAIR_PARTS + 1) * span)
        parts = [p for p in range(PAIR_PARTS) if edges[p] < edges[p + 1]]
        lists = [slice(edges[p], edges[p + 1]) for p in parts]
        none = [None] * len(parts)
        own = block["block"].as_py()
        return (
            [own] * (len(parts) + 1), [-1, *parts],
            [None, *[packed(np.diff(each[s], prepend=p * span)) for p, s in zip(parts, lists, strict=True)]], [None, *[packed(n_each[s]) for s in lists]],
            pa.concat_arrays([one_list(block["ids"].values), pa.nulls(len(parts), block["ids"].type)]),
            [packed(np.bincount(row, minlength=n)), *none], [packed(places), *none], pa.concat_arrays([one_list(pa.array(base, pa.float64())), pa.nulls(len(parts), pa.list_(pa.float64()))]),
        )

    rows = answered(blocks.select("block", "ids", "sizes", "codes", "words"), known, numbered, schema)
    stored = written(rows, "pair-lists", compression="zstd")
    answer = StructType([StructField("block", LongType()), StructField("part", IntegerType()), StructField("counts", BinaryType())])

    def added(lists: pa.Table) -> pa.Table:
        pairs = [np.cumsum(unpacked(x)) for x in lists["pairs"].to_pylist()]
        each, places = np.unique(np.concatenate(pairs), return_inverse=True)
        n = np.concatenate([unpacked(x) for x in lists["n"].to_pylist()])
        total = np.zeros(len(each), np.int64)
        np.add.at(total, places, n)
        found = np.split(total[places], np.cumsum([len(x) for x in pairs])[:-1])
        return pa.table({"block": lists["block"], "part": lists["part"], "counts": pa.array([packed(x) for x in found], pa.binary())})

    totals = stored.where("part >= 0").select("block", "part", "pairs", "n").groupBy("part").applyInArrow(added, answer)
    scores = StructType([StructField("doc_id", ids.elementType), StructField("ll", DoubleType()), StructField("pairs", LongType())])

    def scored(block: dict, found: pa.Table):
        sizes = unpacked(block["sizes"].as_py())
        lists = [unpacked(x) for x in found.sort_by("part")["counts"].to_pylist()]
        lp = np.log(np.concatenate([np.zeros(0), *lists]) + smoothing)[unpacked(block["places"].as_py())]
        ll = np.bincount(np.repeat(np.arange(len(sizes)), sizes), lp, len(sizes)) - block["base"].values.to_numpy()
        some = pa.array(sizes > 0)
        return block["ids"].values.filter(some), pa.array(ll).filter(some), pa.array(sizes).filter(some)

    texts = stored.where("part = -1").select("block", "ids", "sizes", "places", "base")
    return answered(texts, totals, scored, scores)


def perplexity(
    docs: DataFrame,
    text: str = "text",
    smoothing: float = SMOOTHING,
    max_tokens: int | None = None,
    model: PairModel | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """``exp`` of the mean negative log-likelihood of a document's word pairs.

    ``model`` holds the pair counts, by default those of the documents themselves.
    A document without a pair gets NULL. ``max_tokens`` limits the text that is
    looked at; by default all of it counts. ``blocks`` are the texts as ``coded_texts``
    gives them, by default made here; a ``model`` does not need them.
    """
    if model is None:
        rows = _own_scores(coded_texts(docs, text, max_tokens) if blocks is None else blocks, smoothing)
        scored = rows.groupBy("doc_id").agg(F.sum("ll").alias("ll"), F.sum("pairs").alias("pairs"))
    else:
        # Stored: a plain side of the joins.
        counts = written(pair_counts(docs, text, max_tokens), "pair-counts", compression="zstd")
        scored = model.scored(counts, smoothing).groupBy("doc_id").agg(
            F.sum(F.col("n") * F.col("lp")).alias("ll"), F.sum("n").alias("pairs")
        )
    return docs.select("doc_id").join(scored, "doc_id", "left").select(
        "doc_id", F.exp(-F.col("ll") / F.col("pairs")).alias("perplexity")
    )


def generated_text_flag(scored: DataFrame, limit: float = PERPLEXITY_LIMIT) -> DataFrame:
    """Low perplexity is suspicious; no perplexity is not."""
    return scored.withColumn(
        "is_suspicious_ai", F.coalesce(F.col("perplexity") < limit, F.lit(False))
    )


def repetition_ratio(text: Column, size: int = SHINGLE) -> Column:
    """Share of word n-grams that repeat an earlier one; NULL without any."""
    def ratio(t: Column) -> Column:
        grams = F.transform(
            F.slice(t, F.lit(1), F.greatest(F.size(t) - (size - 1), F.lit(0))),
            lambda w, i: F.concat_ws(" ", w, *[F.get(t, i + k) for k in range(1, size)]),
        )
        counted = F.transform(
            F.array(grams),
            lambda g: F.try_divide(F.size(g) - F.size(F.array_distinct(g)), F.size(g)),
        )
        return F.element_at(counted, 1)

    return F.element_at(F.transform(F.array(terms(text)), ratio), 1)


def buzzword_density(text: Column, buzzwords: Sequence[str]) -> Column:
    """Share of the tokens that are buzzwords; NULL without tokens."""
    wanted = [w.lower() for w in buzzwords]
    return F.element_at(
        F.transform(
            F.array(terms(text)),
            lambda t: F.try_divide(F.size(F.filter(t, lambda w: w.isin(*wanted))), F.size(t)),
        ),
        1,
    )
