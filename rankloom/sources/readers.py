"""Readers for texts, question banks, annotated spans and label maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.operators.skills import gazetteer

# ---- fixed values -------------------------------------------------------
DOC_TYPES = ("pdf", "txt")
# The byte sequences of UTF-8.
WELL_FORMED = (
    r"[\x00-\x7F]++|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]"
    r"|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)
# ---- end of fixed values ------------------------------------------------


def decoded(raw: Column) -> Column:
    """Bytes to text: UTF-8, undecodable bytes dropped, line ends as LF. A genuine
    U+FFFD stays."""
    text = raw.cast("string")
    # As Latin-1 every byte is a character: what is part of no sequence leaves.
    latin = F.decode(raw.cast("binary"), "ISO-8859-1")
    kept = F.regexp_replace(latin, F.lit(rf"(?s)({WELL_FORMED})|."), F.lit("$1"))
    text = F.when(F.is_valid_utf8(text), text).otherwise(F.encode(kept, "ISO-8859-1").cast("string"))
    return F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n"))


def doc_scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: its path and whole text."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(
        F.col("_metadata.file_path").alias("path"), decoded(F.col("value").cast("binary")).alias("text")
    )


def accepted_extension(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return extension.isin(*DOC_TYPES)


def doc_ext_filter(docs: DataFrame, path: str = "path") -> DataFrame:
    return docs.where(accepted_extension(F.col(path)))


def question_bank_scan(spark: SparkSession, path: str, schema: str = schemas.QUESTION) -> DataFrame:
    """Files that each hold one JSON array of question objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def span_corpus_scan(
    spark: SparkSession, folder: str, pattern: str = "*.json"
) -> tuple[DataFrame, DataFrame]:
    """Annotated documents, one JSON object per file, and the unreadable files."""
    rows = spark.read.schema(schemas.ANNOTATED + ", _bad string").json(
        folder, multiLine=True, columnNameOfCorruptRecord="_bad", pathGlobFilter=pattern
    ).withColumn("file", F.col("_metadata.file_name"))
    good = rows.where(F.col("_bad").isNull()).drop("_bad")
    # Spark reads the corrupt-record column only beside a parsed one.
    return good, rows.where(F.col("_bad").isNotNull()).select("file", "text", "_bad")


def span_jsonl_scan(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents, one JSON object per line."""
    return spark.read.schema(schemas.ANNOTATED).json(path)


def label_map_rows(json_text: Column) -> Column:
    """``{"0": name, ...}`` exploded to (id, name) rows."""
    return F.explode(F.from_json(json_text, schemas.LABEL_MAP)).alias("id", "name")


def category_dim_scan(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Label maps from JSON files: one map per file, or one per line."""
    return spark.read.text(path, wholetext=not lines).select(label_map_rows(F.col("value")))


def gazetteer_scan(spark: SparkSession, path: str) -> DataFrame:
    """Phrase table from a text file with one phrase per line."""
    lines = spark.read.text(path).select(F.btrim("value").alias("phrase"))
    return gazetteer(lines.where("phrase <> ''"))


def entity_scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
