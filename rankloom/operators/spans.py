"""Annotated spans: checking, careful repair, training examples.

A document's spans stay in its row as an array; nothing is exploded to repair
them and nothing has to be collected again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.cleaning import WS_CHARS, nfc_newlines

# ---- fixed values -------------------------------------------------------
WIDENINGS = (1, 2, 3, 5, 10, 20, 50)
SAMPLE_ROWS = 50
BAD_FORMAT, OUT_OF_BOUNDS, BLANK = "bad-format", "out-of-bounds", "empty-or-whitespace"
# ---- end of fixed values ------------------------------------------------


def raw_spans(spans: Column, annotations: Column) -> Column:
    """``spans`` where given, else ``annotations``; none is an empty array."""
    return F.coalesce(spans, annotations, F.array().cast("array<array<string>>"))


def typed_span(raw: Column) -> Column:
    """``[start, end, label]`` to a struct; what does not parse is NULL inside."""
    return F.struct(
        F.btrim(F.get(raw, F.lit(0))).try_cast("int").alias("start"),
        F.btrim(F.get(raw, F.lit(1))).try_cast("int").alias("end"),
        F.get(raw, F.lit(2)).alias("label"),
        (F.size(raw) >= 3).alias("complete"),
    )


def span_explode(items: DataFrame, file: str = "file") -> DataFrame:
    """One row per raw span with its position and, if malformed, the reason."""
    raw = raw_spans(F.col("spans"), F.col("annotations"))
    typed = items.select(file, F.posexplode(F.transform(raw, typed_span)).alias("pos", "s"))
    return typed.select(
        file, "pos", "s.start", "s.end", "s.label",
        F.when(_malformed(F.col("s")), BAD_FORMAT).alias("reason"),
    )


def _malformed(span: Column) -> Column:
    return span["start"].isNull() | span["end"].isNull() | ~F.coalesce(span["complete"], F.lit(False))


def repaired_span(text: Column, span: Column) -> Column:
    """The span kept, clipped or widened until it covers some text, or NULL
    bounds with the reason. Wider ranges are tried only if narrower ones fail."""
    size = F.length(text)
    start, end = span["start"], span["end"]

    def some_text(s: Column, e: Column) -> Column:
        return (s < e) & (
            F.length(F.btrim(F.substring(text, s + 1, e - s), F.lit(WS_CHARS))) > 0
        )

    outside = (start < 0) | (end > size) | (start >= end)
    low, high = F.greatest(start, F.lit(0)), F.least(end, size)
    tries = [
        F.when(some_text(s, e), F.struct(s.alias("start"), e.alias("end")))
        for s, e in (
            (F.greatest(low - w, F.lit(0)), F.least(high + w, size)) for w in (0, *WIDENINGS)
        )
    ]
    found = F.when(~_malformed(span), F.coalesce(*tries))
    good = ~outside & some_text(start, end)

    def result(fit: Column) -> Column:
        reason = F.when(_malformed(span), BAD_FORMAT).when(
            fit.isNull(), F.when(outside, OUT_OF_BOUNDS).otherwise(BLANK)
        )
        return F.struct(
            fit["start"].alias("start"),
            fit["end"].alias("end"),
            span["label"].alias("label"),
            (fit.isNotNull() & ~good).alias("fixed"),
            reason.alias("reason"),
        )

    # One-element transform: binds the search once for its several uses.
    return F.element_at(F.transform(F.array(found), result), 1)


def span_repair(items: DataFrame) -> DataFrame:
    """Normalise the text and repair every span of ``spans``/``annotations``."""
    raw = raw_spans(F.col("spans"), F.col("annotations"))
    return (
        items.withColumn("text", nfc_newlines(F.coalesce("text", F.lit(""))))
        .withColumn("_typed", F.transform(raw, typed_span))
        .withColumn("repaired", F.transform("_typed", lambda s: repaired_span(F.col("text"), s)))
        .drop("_typed")
    )


def span_examples(repaired: DataFrame) -> DataFrame:
    """One example per document; without usable spans the list is empty."""
    kept = F.filter("repaired", lambda s: s["reason"].isNull())
    spans = F.transform(kept, lambda s: F.struct(s["start"], s["end"], s["label"]))
    return repaired.select("file", "text", spans.alias("spans"))


def span_stats(repaired: DataFrame) -> DataFrame:
    fixed = F.size(F.filter("repaired", lambda s: s["fixed"]))
    skipped = F.size(F.filter("repaired", lambda s: s["reason"].isNotNull()))
    return repaired.agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.coalesce(F.sum(F.size("repaired")), F.lit(0)).alias("total_spans_found"),
        F.coalesce(F.sum(fixed), F.lit(0)).alias("fixed_spans"),
        F.coalesce(F.sum(skipped), F.lit(0)).alias("skipped_spans"),
    )


def repaired_rows(repaired: DataFrame, *keys: str) -> DataFrame:
    """One row per span. The outer form keeps the optimizer from testing the
    array's size first, which would repair every span twice."""
    rows = repaired.select(*keys, F.posexplode_outer("repaired").alias("pos", "s"))
    return rows.where("pos is not null")


def rejected_sample(repaired: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rejected spans in file order."""
    return (
        repaired_rows(repaired, "file").where("s.reason is not null")
        .select("file", "pos", "s.label", "s.reason")
        .orderBy("file", "pos")
        .limit(rows)
    )
