"""Schemas of the entities, as Spark DDL. Sources never infer."""

from __future__ import annotations

ANNOTATED = "text string, spans array<array<string>>, annotations array<array<string>>"

QUESTION = (
    "question_text string, question_type string, difficulty string, category string, "
    "option_a string, option_b string, option_c string, option_d string, "
    "correct_answer string, "
    "test_cases array<struct<input: string, expected_output: string>>, "
    "reference_answer string, reference_vector array<float>"
)

LABEL_MAP = "map<string, string>"

ACTIVITY = "event_id bigint, candidate_id bigint, flags string, suspicious boolean, ts timestamp"
