"""Skill phrases in texts: tokens, a phrase table, an equi-join.

Texts stay in blocks; only their different tokens and the runs that may be a phrase are
exchanged. The cost is linear in the tokens times the phrase lengths there are, and does not
depend on the number of phrases. The phrase table is a parameter: read it from a file, build it from
any column, or mine it from annotated spans.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rankloom.functions.cleaning import WS, py_strip, words
from rankloom.operators.blocks import PART_BYTES, answered, coded, of_words, row_of_each

# ---- fixed values -------------------------------------------------------
# Punctuation that is a token of its own at either end of a word; a full stop
# is one only at the end. Inside a word these split it:
#   a comma or hyphen between letters, : < > = / before a letter.
EDGE = r",:;!?()\[\]{}<>_#*&'" + '"`“”‘’…'
INNER = (
    r"(?<=\p{L}),(?=\p{L})"
    r"|(?<=\p{L})(?:---|--|-|–|—)(?=\p{L})"
    r"|(?<=[\p{L}0-9])[:<>=/](?=\p{L})"
)
# English words that are two tokens, and abbreviations that keep their full stop.
NEGATED = (
    "ai", "are", "ca", "could", "did", "does", "do", "had", "has", "have", "is", "might", "must", "need",
    "should", "was", "were", "wo", "would",
)
SHORTENED = ("s", "m", "d", "ll", "re", "ve")
JOINED = (("can", "not"), ("gon", "na"), ("got", "ta"), ("wan", "na"), ("lem", "me"), ("gim", "me"))
ABBREVIATIONS = (
    "a.m", "p.m", "e.g", "i.e", "vs", "etc", "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "ph.d", "inc", "ltd",
    "co", "corp", "dept", "est", "approx", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
# ---- end of fixed values ------------------------------------------------

# Each starts with a cheap test that ordinary letters fail.
_INNER = rf"(?=[-,:<>=/–—])(?:{INNER})"
_LEADING = rf"(?=[{EDGE}])(?:(?<![^{WS}])|\G(?<=[{EDGE}]))[{EDGE}]"
# Looks ahead once per run of punctuation, then goes on from hit to hit.
_TRAILING = (
    rf"(?=[{EDGE}.])(?:(?<![{EDGE}.])(?=[{EDGE}.]++(?![^{WS}]))|\G(?<=[{EDGE}.]))[{EDGE}.]"
)


# A full stop that belongs to its word is set aside under a character of the private
# use area until the rest is parted.
_STOP = "\ue000"
# The full stop, the rarer part, is looked for before the word in front of it.
_ABBREVIATED = rf"\.(?<=(?<![^{WS}{EDGE}])(?:{'|'.join(map(re.escape, ABBREVIATIONS))})\.)(?=[{EDGE}.]*+(?![^{WS}]))"


def _second(first: str, second: str) -> str:
    """``second`` at the end of a word that begins with ``first``; its own letters are tested first."""
    return rf"{second}(?![^{WS}])(?<=(?<![^{WS}])(?:{first}){second})"


_TWO = "(?=['ntm])(?:" + "|".join([
    _second("|".join(NEGATED), "n't"),
    rf"'(?<=\p{{L}}')(?:{'|'.join(SHORTENED)})(?![^{WS}])",
    *[_second(a, b) for a, b in JOINED],
]) + ")"


def tokenise(text: Column) -> Column:
    """Lower-case tokens; ``node.js`` and ``.net`` stay whole, ``pci-dss`` is
    three tokens, ``python.`` is two. ``don't`` is ``do`` and ``n't``, ``it's`` is ``it``
    and ``'s``, ``cannot`` is ``can`` and ``not``; ``e.g.`` keeps its full stop."""
    text = F.lower(text)
    text = F.regexp_replace(text, F.lit(_ABBREVIATED), F.lit(_STOP))
    text = F.regexp_replace(text, F.lit(_INNER), F.lit(" $0 "))
    text = F.regexp_replace(text, F.lit(_LEADING), F.lit("$0 "))
    text = F.regexp_replace(text, F.lit(_TRAILING), F.lit(" $0"))
    text = F.regexp_replace(text, F.lit(_TWO), F.lit(" $0"))
    return words(F.translate(text, _STOP, "."))


def gazetteer(phrases: DataFrame, column: str = "phrase") -> DataFrame:
    """Distinct phrases with their tokens."""
    return (
        phrases.select(F.lower(F.col(column)).alias("skill"))
        .where(py_strip(F.col("skill")) != "")
        .distinct()
        .withColumn("phrase_tokens", tokenise(F.col("skill")))
    )


def skill_match(docs: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, skill, hits)``; overlapping phrases all count.

    A block of texts asks once for each of its different tokens whether a phrase begins
    with it. The runs of tokens of every length that a phrase has, from such a token on,
    then meet the whole phrases: at most tokens times lengths rows, however many phrases
    start alike. They are counted per text before they meet.
    """
    lengths = phrases.agg(F.collect_set(F.size("phrase_tokens")).alias("n")).scalar()
    blocks = coded(docs, tokenise(F.col(text)), PART_BYTES)
    firsts = phrases.select(F.get("phrase_tokens", F.lit(0)).alias("word")).distinct()
    asked = of_words(blocks).join(firsts, "word", "left_semi").select("block", "place")
    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("_gram", StringType()), StructField("_n", LongType()),
    ])

    def grams(block: dict, found: pa.Table):
        row, code, _ = row_of_each(block)
        ids, words = block["ids"].values, block["words"].values
        begins = np.zeros(len(words) + 1, bool)
        begins[found["place"].to_numpy()] = True
        places = np.flatnonzero(begins[code])
        columns = [ids.slice(0, 0)], [pa.array([], pa.string())], [pa.array([], pa.int64())]
        for n in block["lengths"].as_py():
            at = places[places + n <= len(row)]
            at = at[row[at] == row[at + n - 1]]
            joined = pc.binary_join_element_wise(*[words.take(pa.array(code[at + k])) for k in range(n)], " ").dictionary_encode()
            size = max(1, len(joined.dictionary))
            each, times = np.unique(row[at] * size + joined.indices.to_numpy(zero_copy_only=False), return_counts=True)
            for column, values in zip(columns, (ids.take(pa.array(each // size)), joined.dictionary.take(pa.array(each % size)), pa.array(times)), strict=True):
                column.append(values)
        return [pa.concat_arrays(c) for c in columns]

    told = blocks.select("block", "ids", "sizes", "codes", "words", F.coalesce(lengths, F.array().cast("array<int>")).alias("lengths"))
    counted = answered(told, asked, grams, schema).groupBy("doc_id", "_gram").agg(F.sum("_n").alias("_n"))
    whole = phrases.select("skill", F.array_join("phrase_tokens", " ").alias("_gram"))
    return counted.join(whole, "_gram").groupBy("doc_id", "skill").agg(F.sum("_n").alias("hits"))


def skill_pool(docs: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """Distinct sorted skills per text (never more than the phrase table has);
    texts without any get an empty list, null texts are left out."""
    found = skill_match(docs, phrases, text).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("skill")).alias("skills")
    )
    return (
        docs.where(F.col(text).isNotNull())
        .select("doc_id")
        .join(found, "doc_id", "left")
        .withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    )


def skill_overlap(has: Column, wants: Column) -> Column:
    """Shared skills, sorted."""
    return F.array_sort(F.array_intersect(has, wants))


def overlap_ratio(has: Column, wants: Column) -> Column:
    """Share of the wanted skills that are there; NULL when none is wanted."""
    return F.try_divide(F.size(F.array_intersect(has, wants)), F.size(F.array_distinct(wants)))


def missing_skills(has: Column, wants: Column) -> Column:
    """Wanted skills that are not there, sorted."""
    return F.array_sort(F.array_except(wants, has))


def label_inventory(spans: DataFrame) -> DataFrame:
    """Span labels with their number of spans and of files."""
    per_file = spans.groupBy("label", "file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("label").agg(
        F.sum("n").alias("spans"), F.count(F.lit(1)).alias("files")
    )


def mined_gazetteer(inventory: DataFrame, prefix: str = "SKILL: ", least_spans: int = 1) -> DataFrame:
    """Phrase table from the labels ``SKILL: <name>`` of annotated texts."""
    named = inventory.where(
        F.col("label").startswith(prefix) & (F.col("spans") >= least_spans)
    )
    return gazetteer(named.select(F.substring("label", len(prefix) + 1, 2**31 - 1).alias("phrase")))
