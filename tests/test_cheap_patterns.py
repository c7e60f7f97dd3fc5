"""Patterns whose costly part is met only where a cheap one holds."""

import unicodedata

from pyspark.sql import functions as F

from rankloom.functions import cleaning
from rankloom.operators import skills


def test_token_patterns_test_a_rare_character_first():
    assert skills._ABBREVIATED.startswith(r"\.")
    assert skills._TWO.startswith("(?=['ntm])")


def test_contractions_and_abbreviations_stay_as_they_were(spark):
    wanted = {
        "Don't say e.g. that, vs. corp. x": ["do", "n't", "say", "e.g.", "that", ",", "vs.", "corp.", "x"],
        "it's cannot cannots gonna gimme lemme.": ["it", "'s", "can", "not", "cannots", "gon", "na", "gim", "me", "lem", "me", "."],
        "xdon't n't 's (etc.) mr.x a.m.": ["xdon't", "n't", "'", "s", "(", "etc.", ")", "mr.x", "a.m."],
    }
    rows = spark.createDataFrame([(t,) for t in wanted], "t string")
    assert {r.t: r.x for r in rows.select("t", skills.tokenise(F.col("t")).alias("x")).collect()} == wanted


def test_the_class_of_changeable_characters_is_short(spark):
    pattern = cleaning.changeable()
    assert pattern.count("\\x{") < 250
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not unicodedata.is_normalized("NFC", chr(c))]
    texts = [*chars, *["e" + c for c in "̧́"], "plain é “text” Я 中 한"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", F.regexp_like("t", F.lit(pattern)).alias("some"), cleaning.nfc_newlines(F.col("t")).alias("n")).collect()
    assert [r.t for r in found if not r.some] == texts[-1:]
    assert all(r.n == unicodedata.normalize("NFC", r.t) for r in found)
