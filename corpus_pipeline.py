"""From raw documents to packed training sequences, in four stages.

What every stage does with rows out of the ordinary: a null text counts as empty. No
rows give no rows. Columns beside those of ``documents`` stay, whatever their names,
but for the last stage, which returns pieces. Nothing depends on the order of rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import decision_list, knn_quality, packing, simhash
from rankloom.llm.common import table
from rankloom.session import written

LEAST_SCORE = 0.3
SHINGLE, BITS = 3, 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep.

    Null and empty texts have fewer than 50 words and go. A very long text is measured
    whole. Repeated rows get one verdict; a row without id is judged like any other.
    """
    return decision_list.accepted(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours call good.

    The earlier stage leaves hardly any bad document to learn from, so the
    labels' documents are read from the whole table. A null or empty text gets the
    prior, a very long one is read whole. Repeated rows get one score; neighbours that
    tie with the last one all vote.
    """
    labels = table(spark, sf_dir, "labels")
    model = knn_quality.fit(table(spark, sf_dir, "documents"), labels, usable=knn_quality.learnable())
    return knn_quality.accepted(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id.

    Texts without a word share one fingerprint and are one group. A null id comes last,
    equal ids go by the hash of the text, and rows equal in both are one document.
    """
    return simhash.survivors(docs, SHINGLE, BITS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in windows of 4096, with their token ids.

    A null or empty text is the end id alone, a very long one is cut into windows.
    Repeated rows are pieces of their own; pieces of one length are placed by id and
    start, those equal in both in any order.
    """
    pieces = packing.tokenised(docs, public_tokenizers.path("word_bpe_49k.json"), compressed=True)
    return packing.pack(pieces, compressed=("ids",)).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("packing", pack),
]
#: The decision list, the neighbours' votes and the packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
