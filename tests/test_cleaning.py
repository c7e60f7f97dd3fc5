"""Each stage against Python's own ``re``, rule by rule."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from rankloom.functions import cleaning as C

MONTH_DATE = rf"(?i)\b({C.MONTHS})[a-z]*\s+\d{{1,2}},?\s+\d{{4}}\b"


def blank(text, *patterns):
    for pattern in patterns:
        text = re.sub(pattern, " ", text)
    return text


def pii(text):
    return blank(
        text.lower(), r"\S+@\S+\.\S+", r"https?://\S+|www\.\S+",
        r"github\.com/[\w-]+/?[\w-]*/?", r"linkedin\.com/in/[\w-]+", r"@[\w-]+",
        r"\+?\d{1,3}[-.\s]?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}", r"\b\d{10,15}\b",
        r"\b(19|20)\d{2}\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", MONTH_DATE,
        r"(?i)\b(present|current|now)\b", r"\b\d{5}(?:-\d{4})?\b",
    )


def headers(text):
    return blank(text, *[rf"(?i)\b({'|'.join(g)})\b" for g in C.SECTION_TITLES])


def artifacts(text):
    runs = [rf"{re.escape(c)}{{3,}}" for c in "=-*_─━•◦"]
    return blank(text, *runs, f"[{C.BULLETS}]", r"\*+", r"_{2,}", "`+", "#+")


def ascii_only(text):
    text = blank(text, r"[^\x00-\x7F]+", r"[^a-zA-Z0-9\s.,!?:;\-']")
    for mark, into in (("'", "'"), ("-", "-"), (r"\.", ". "), (",", ", "), (r"\?", "? "), ("!", "! ")):
        text = re.sub(rf"\s+{mark}\s+", into, text)
    return re.sub(r"\s+", " ", blank(text, r"\b\d+(?:\.\d+)?\b")).strip()


def no_short(text):
    return " ".join(w for w in text.split() if len(w) > 1 or w in C.SHORT_WORDS)


def whole(text):
    return no_short(ascii_only(artifacts(headers(pii(text)))))


STAGES = {
    "pii_strip": pii, "section_header_strip": headers, "format_artifact_strip": artifacts,
    "ascii_punct_normalise": ascii_only, "short_token_filter": no_short, "clean_text": whole,
}

BY_HAND = [
    "", " ", "Mail ann@example.com or x@y, see https://a.b/c?d www.e.f now",
    "github.com/me/repo/ linkedin.com/in/me @me a@b@c.d @a@b.c",
    "+1 (555) 123-4567, 0123456789, 555.123.4567", "2019-2021 March 5, 1823 Jan 5 2020 12/05/2020 1/2/1850",
    "12345 12345-6789 123456 react18 3.5 3 years",
    "Soft Skills additional projects featured work experience",
    "community work experience, community work history, community work",
    "Professional Summary / TECH STACK: c, r, go, c#, f# — x",
    "==== -- --- ** *** __ _ ___ ```code``` ### • •••• ◦ → ✓ – 【a】",
    "it ' s well - known . Really ? Yes ! a , b", "a - ' b ' - c . , d",
    "café naïve ｆｕｌｌ ² ٣٤ 19٢٠ é İstanbul ſkills lıcenses",
    "tab\tnewline\r\nvertical\x0bfile\x1csep\xa0nbsp line",
    "x" * 5000 + "@" + "y" * 50 + ".z", "-" * 4000 + "é" * 4000,
]


def made_up(n):
    rnd = random.Random(11)
    pieces = sorted({w for g in C.SECTION_TITLES for t in g for w in t.split()})
    pieces += "now may 5, 1234 2020 12/05/2020 a@b.co https://x.y +1 555-123-4567 12345 c r x é --- ** ' - . , ? ! 3.5 don't".split()
    gaps = [" ", " ", " ", "  ", "\n", "-", "/", "", ".", " - ", " . ", ", "]
    return ["".join(rnd.choice(pieces) + rnd.choice(gaps) for _ in range(rnd.randint(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = BY_HAND + made_up(3000)
    return spark.createDataFrame([(t,) for t in rows], "t string").repartition(4).cache()


@pytest.mark.parametrize("stage", STAGES)
def test_stage_equals_python(texts, stage):
    out = texts.select("t", getattr(C, stage)(F.col("t")).alias("x")).collect()
    bad = [(r.t, STAGES[stage](r.t), r.x) for r in out if STAGES[stage](r.t) != r.x]
    assert bad[:3] == []


def test_order_of_rules(spark):
    # Skills goes before soft skills; a bare year before the month-name date.
    row = spark.sql("SELECT 'soft skills' a, 'January 5, 2020' b, 'CI/CD and C# at 40' c")
    out = row.select(*[C.clean_text(F.col(c)).alias(c) for c in "abc"]).first()
    assert (out.a, out.b, out.c) == ("soft", "january", "ci cd and c at")


def test_null_stays_null(spark):
    out = spark.sql("SELECT CAST(NULL AS STRING) t").select(
        C.clean_text(F.col("t")), C.chunk_words(F.col("t")), C.nfc_newlines(F.col("t"))
    ).first()
    assert tuple(out) == (None, None, None)


def test_chunks_hold_every_word(texts):
    for row in texts.select("t", C.chunk_words(F.col("t"), 7).alias("c")).collect():
        words = row.t.split()
        assert row.c == [" ".join(words[i:i + 7]) for i in range(0, len(words), 7)]


def test_nfc_and_newlines(spark):
    texts = ["é ä", "plain", "a\r\nb\rc\n", "Å", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    out = [r[0] for r in df.select(C.nfc_newlines(F.col("t"))).collect()]
    expected = [
        t and unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n") for t in texts
    ]
    assert out == expected
