"""The pipeline's stages against what their operators say, one by one."""

import zlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import packing
from rankloom.llm.queries import QUERIES
from tests.llm.test_operators import plain_components, plain_simhash


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, small)
    verdict = {r.doc_id for r in QUERIES["op6_quality_rules"](spark, small).where("kept").collect()}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == verdict

    good = stages["quality classifier"](spark, kept, small)
    scores = {r.doc_id: r.predicted for r in QUERIES["op9_quality_knn"](spark, small).collect()}
    assert good.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    assert {k for k, _ in rows} == {k for k in verdict if scores[k] == 1}

    single = stages["near duplicates"](spark, good, small)
    assert single.columns == docs.columns
    groups = plain_components([plain_simhash(t) for _, t in rows], 2)
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[g][0] for g in groups})

    packed = stages["packing"](spark, single, small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in single.collect()}
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= packing.WINDOW
    assert len(fill) == -(-sum(fill.values()) // packing.WINDOW)


def test_run_is_the_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    run = corpus_pipeline.run(spark, small)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(run.select(*key).collect()) == sorted(docs.select(*key).collect())


def test_sequences_can_be_built_from_the_result(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(30)
    packed = corpus_pipeline.pack(spark, docs, small).collect()
    want = packing.tokenised(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    key = lambda r: (r.doc_id, r.start)
    assert {key(r): bytes(r.ids) for r in packed} == {key(r): bytes(r.ids) for r in want}
    assert all(len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids) for r in packed)


def test_stages_on_rows_out_of_the_ordinary(spark, small):
    """Null ids and texts, empty and very long texts, repeats, clashing names, no rows."""
    plain = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    some = {r.doc_id: r.text for r in plain.collect()}
    long = max(some.values(), key=len)
    odd = [(None, long), (None, None), (9001, None), (9002, ""), (9003, " \t\n"), (9004, (long + "\n") * 40), (7, some[7]), (7, some[7])]
    rows = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in odd], plain.schema)
    names = ("n", "score", "rank", "length", "_hash", "text_hash", "fingerprint", "group", "quality")
    docs = plain.union(rows).withColumns({name: F.lit("clash") for name in names}).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    none = docs.where("false")

    def kept(name):
        out = stages[name](spark, docs, small)
        assert out.columns == docs.columns
        assert stages[name](spark, none, small).count() == 0
        found = [tuple(r) for r in out.collect()]
        assert set(found) <= {tuple(r) for r in docs.collect()}
        return found

    ruled = kept("quality rules")
    assert not {9001, 9002, 9003} & {r[0] for r in ruled}
    assert sum(r[0] == 7 for r in ruled) in (0, 3)  # repeated rows share a verdict
    good = kept("quality classifier")
    assert sum(r[0] == 7 for r in good) in (0, 3)
    single = kept("near duplicates")
    assert sum(r[0] == 7 for r in single) == 1
    assert sum(not (r[1] or "").split() for r in single) == 1  # one of the texts without a word
    pieces = stages["packing"](spark, docs, small).collect()
    assert stages["packing"](spark, none, small).count() == 0
    assert {r.doc_id for r in pieces if r.doc_tokens == 1} == {None, 9001, 9002, 9003}
    whole = [r for r in pieces if r.doc_id == 9004]
    assert sum(r.length for r in whole) == whole[0].doc_tokens and len(whole) > 2
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
