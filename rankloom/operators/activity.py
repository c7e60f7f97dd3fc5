"""Proctoring flags per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: flag name in the log, name of the count ---------------
FLAGS = (
    ("notFocused", "not_focused"),
    ("multiplefacesdetected", "multiple_face_count"),
    ("tabSwitch", "tab_switch_count"),
    ("noFaceDetected", "no_face_count"),
    ("devToolsOpen", "devtools_count"),
    ("copyAttempted", "copy_attempted"),
)
# ---- end of fixed values ------------------------------------------------


def parse_flags(flags: Column) -> Column:
    """JSON text to VARIANT; JSON inside a JSON string is parsed once more."""
    outer = F.try_parse_json(flags)
    inner = F.try_parse_json(F.try_variant_get(outer, "$", "string"))
    return F.when(F.schema_of_variant(outer) == "STRING", inner).otherwise(outer)


def flag_is_set(variant: Column, name: str) -> Column:
    """True for a JSON true and for the number one, as in ``value == True``."""
    value = F.to_json(F.try_variant_get(variant, f"$.{name}", "variant"))
    number = value.try_cast("double")
    return F.coalesce((value == "true") | (number == 1), value == "true", F.lit(False))


def flag_totals(logs: DataFrame) -> DataFrame:
    """Set flags per candidate; counts merge map-side, so one candidate may
    hold any share of the logs. Works on a stream as well."""
    parsed = logs.withColumn("_flags", parse_flags(F.col("flags")))
    return parsed.groupBy("candidate_id").agg(
        *[F.count_if(flag_is_set(F.col("_flags"), flag)).alias(name) for flag, name in FLAGS]
    )


def flag_counts(candidates: DataFrame, logs: DataFrame) -> DataFrame:
    """Flag counts of every candidate, 0 without logs."""
    counted = candidates.join(flag_totals(logs), "candidate_id", "left")
    return counted.fillna(0, [name for _, name in FLAGS])
