"""One query for each operator, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import (
    bpe,
    decision_list,
    histogram_sort,
    knn_quality,
    language_id,
    log_bilinear,
    one_permutation,
    order_minhash,
    packing,
    simhash,
    spelling,
    url_filter,
    whitening,
)
from rankloom.llm.common import in_bucket, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GOOD = 0.3


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op6_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return decision_list.quality_rules(docs, labels)


@query
def op8_packing(spark, sf_dir):
    pieces = packing.tokenised(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), compressed=True
    )
    # The digest is that of the ids that were packed.
    return packing.pack(pieces, compressed=("ids",)).withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op9_quality_knn(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = knn_quality.fit(docs, labels, usable=knn_quality.learnable())
    scored = knn_quality.score(docs, model)
    return scored.select(
        "doc_id", in_bucket(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


@query
def op4_byte_bpe(spark, sf_dir):
    coded = bpe.coded(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
    )
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = in_bucket(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~held_out))
    return language_id.predicted(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


#: Of the contract; the longest that fits decides.
HOST_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Host labels that block where none of those fits.
BLOCKED_NAMES = (
    "casino-win", "free-casino", "online-casino", "cheap-pills", "online-pills", "free-bets", "best-bets",
    "spam-farm", "link-farm", "adult-chat", "payday-loans", "replica-watches",
)


def url_rules() -> list[url_filter.Rule]:
    hosts = [url_filter.host_rule(*rule) for rule in HOST_RULES]
    return hosts + [url_filter.name_rule("block", name) for name in BLOCKED_NAMES]


@query
def op10_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"), url_rules())


@query
def op1_order_minhash(spark, sf_dir):
    pairs = order_minhash.edited_pairs(table(spark, sf_dir, "documents"))
    s, e = F.col("s"), F.col("edited_s")
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        order_minhash.as_text(s).alias("fingerprint"), order_minhash.as_text(e).alias("edited_fingerprint"),
        order_minhash.likeness(s, e).alias("near_edited"),
        order_minhash.likeness(s, F.col("next_s")).alias("near_next"),
    )


@query
def op2_histogram_sort(spark, sf_dir):
    placed = histogram_sort.sharded(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_log_bilinear(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = in_bucket(F.col("doc_id"), 7, 2)
    model, counted = log_bilinear.fit(docs.where(~held_out))
    return log_bilinear.scored(docs, model, counted).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op11_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fit(vectors))


@query
def op12_minhash(spark, sf_dir):
    found = one_permutation.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))
