"""Files in, tables out, and streams against their batch twins."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from rankloom import session
from rankloom.operators import activity, ml
from rankloom.plans.entities import Entities
from rankloom.plans.registry import QUERIES
from rankloom.sources import readers, sinks
from rankloom.streaming import activity as live


def test_doc_scan(spark, tmp_path):
    raw = {
        "a.txt": b"one\r\ntwo\rthree\n", "b.txt": b"bad \xff\xe2\x82 bytes", "c.txt": "kept � é".encode(), "d.txt": b"",
    }
    for name, data in raw.items():
        (tmp_path / name).write_bytes(data)
    expected = {n: open(tmp_path / n, encoding="utf-8", errors="ignore").read() for n in raw}
    out = {os.path.basename(r.path): r.text for r in readers.doc_scan(spark, str(tmp_path)).collect()}
    assert out == {k: v for k, v in expected.items() if k in out}
    assert set(out) >= {"a.txt", "b.txt", "c.txt"}


@pytest.mark.parametrize("path, ok", [("a.pdf", True), ("x/b.TXT", True), ("c.docx", False), ("txt", False), ("a.txt/b", False)])
def test_extension(spark, path, ok):
    df = spark.createDataFrame([(path,)], "path string")
    assert readers.doc_ext_filter(df).count() == int(ok)


def test_question_bank(spark, tmp_path):
    items = [{"question_text": "q", "question_type": "code", "test_cases": [{"input": "1", "expected_output": "2"}]}, {"question_text": "r"}]
    (tmp_path / "bank.json").write_text(json.dumps(items, indent=1))
    rows = readers.question_bank_scan(spark, str(tmp_path)).orderBy("question_text").collect()
    assert [r.question_text for r in rows] == ["q", "r"] and rows[0].test_cases[0].expected_output == "2"


def test_span_corpus(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text": "t", "annotations": [[0, 1, "L"]]}')
    (tmp_path / "b.json").write_text('{"text": "u", "spans": [["0", 1, "M"]], "annotations": []}')
    (tmp_path / "c.json").write_text('{"text": "u", "spa')
    (tmp_path / "d.txt").write_text("no")
    good, bad = readers.span_corpus_scan(spark, str(tmp_path))
    assert {r.file: (r.text, r.annotations) for r in good.collect()} == {"a.json": ("t", [["0", "1", "L"]]), "b.json": ("u", [])}
    assert [r.file for r in bad.collect()] == ["c.json"]


def test_span_lines_and_label_map(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "t", "annotations": [[0, 1, "L"]]}\n{"text": "u"}\n')
    assert readers.span_jsonl_scan(spark, str(tmp_path / "x.jsonl")).count() == 2
    (tmp_path / "m.json").write_text('{"0": "A",\n "1": "B"}')
    assert {tuple(r) for r in readers.category_dim_scan(spark, str(tmp_path / "m.json")).collect()} == {("0", "A"), ("1", "B")}
    (tmp_path / "g.txt").write_text("Go\n\n go \nnode.js\n")
    assert {r.skill for r in readers.gazetteer_scan(spark, str(tmp_path / "g.txt")).collect()} == {"go", "node.js"}


def test_backfill_and_writeback(spark):
    q = spark.createDataFrame(
        [(1, "subjective", "red fox", None), (2, "subjective", None, None), (3, "mcq", "x", [1.0])],
        "id int, question_type string, reference_answer string, reference_vector array<float>",
    )
    out = {r.id: r.reference_vector for r in sinks.vector_backfill(q).collect()}
    assert len(out[1]) == ml.DIMENSIONS and not any(out[2]) and out[3] == [1.0]
    rows = spark.createDataFrame([(1, 0.1), (2, 0.2)], "app_id int, score double")
    new = spark.createDataFrame([(2, 0.9)], "app_id int, score double")
    assert {tuple(r) for r in sinks.score_writeback(rows, new, "app_id").collect()} == {(1, 0.1), (2, 0.9)}


def test_shared_folder_is_the_session_setting(spark):
    folder = session.shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    assert session.new_table_path(spark, "t").startswith(folder)


def test_stream_counts_equal_batch(spark, small):
    e = Entities(spark, small)
    got = QUERIES["activity_stream_counts"](spark, small)
    batch = activity.flag_totals(e.logs())
    assert got.select(batch.columns).exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_stream_drops_repeats_and_resumes(spark, tmp_path):
    """Two batches, one record delivered twice, a restart in between."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "event_id bigint, candidate_id bigint, flags string, ts timestamp"
    def deliver(ids):
        rows = spark.createDataFrame([(i, i % 2, '{"tabSwitch": true}') for i in ids], "event_id bigint, candidate_id bigint, flags string")
        rows.withColumn("ts", F.to_timestamp(F.lit("2024-01-01"))).write.mode("append").parquet(source)
    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        live.activity_stream_counts(stream, out, checkpoint).awaitTermination()
    deliver([1, 2, 3])
    run()
    time.sleep(1)
    deliver([3, 4, 5])
    run()
    counts = {r.candidate_id: r.tab_switch_count for r in live.current_counts(spark, out).collect()}
    assert counts == {0: 2, 1: 3}


def test_stream_counts_records_however_late(spark, tmp_path):
    """Three batches; the last holds a record hours older than all before."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "event_id bigint, candidate_id bigint, flags string, ts timestamp"
    for i, ts in enumerate(("2024-01-01 10:00:00", "2024-01-01 18:00:00", "2024-01-01 06:00:00")):
        row = spark.createDataFrame([(i, 1, '{"tabSwitch": true}', ts)], "event_id bigint, candidate_id bigint, flags string, ts string")
        row.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        live.activity_stream_counts(stream, out, checkpoint).awaitTermination()
    assert [r.tab_switch_count for r in live.current_counts(spark, out).collect()] == [3]


def test_rescoring_stream_equals_batch(spark, small):
    a, b = (QUERIES[n](spark, small).select("app_id", "score") for n in ("rescore_on_apply", "chunk_maxsim"))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
