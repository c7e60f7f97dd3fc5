"""Document vectors and category prediction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.categories import CATEGORIES, label_decode
from rankloom.operators.text_stats import terms
from rankloom.session import new_table_path

DIMENSIONS = 384  # fixed value


def hashed_encoder(df: DataFrame, text: str, out: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Hashed term frequencies of unit length; no fit, no shuffle."""
    df = df.withColumn("_terms", terms(F.coalesce(F.col(text), F.lit(""))))
    df = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dimensions).transform(df)
    df = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(df)
    return df.withColumn(out, vector_to_array("_unit", "float32")).drop("_terms", "_tf", "_unit")


BATCH = 32  # fixed value
_loaded: dict[str, Callable[[list[str]], np.ndarray]] = {}


def batch_encoder(
    name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = BATCH, unit: bool = True
) -> Callable[[DataFrame, str, str], DataFrame]:
    """An encoder from a model: ``load()`` gives a function from texts to rows of
    numbers. It is called once in a Python worker for a ``name``, and kept for the
    worker's further tasks. Texts are coded ``batch`` at a time, those of like length
    together, and come back in their order; null counts as empty. With ``unit``
    vectors have length 1, but for zero ones."""
    def encoder(df: DataFrame, text: str, out: str) -> DataFrame:
        @F.pandas_udf("array<float>")
        def encoded(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if name not in _loaded:
                _loaded.clear()  # one model at a time
                _loaded[name] = load()
            for column in columns:
                texts = column.fillna("").tolist()
                order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
                vectors: list = [None] * len(texts)
                for start in range(0, len(order), batch):
                    some = order[start : start + batch]
                    rows = np.asarray(_loaded[name]([texts[i] for i in some]), dtype=np.float32)
                    if unit:
                        length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True)).astype(np.float32)
                        rows = rows / np.where(length == 0, np.float32(1), length)
                    for i, row in zip(some, rows, strict=True):
                        vectors[i] = row
                yield pd.Series(vectors)

        return df.withColumn(out, encoded(F.col(text)))

    return encoder


def embed(
    df: DataFrame,
    text: str = "text",
    out: str = "vector",
    encoder: Callable[[DataFrame, str, str], DataFrame] = hashed_encoder,
) -> DataFrame:
    """Add a vector per text. ``encoder(df, text, out)`` may be any, for example one
    made by ``batch_encoder``."""
    return encoder(df, text, out)


def fit_category_model(
    labelled: DataFrame, vector: str = "vector", label: str = "label",
    trees: int = 20, depth: int = 5, seed: int = 42,
) -> RandomForestClassificationModel:
    features = labelled.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(features)


def category_classify(
    docs: DataFrame,
    model: RandomForestClassificationModel,
    vector: str = "vector",
    categories=CATEGORIES,
) -> DataFrame:
    """Add the predicted number and its category name."""
    scored = model.transform(
        docs.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    )
    return scored.withColumn(
        "category", label_decode(F.col("prediction"), categories)
    ).drop("features", "rawPrediction", "probability")


def saved_model(spark, model: RandomForestClassificationModel) -> str:
    path = new_table_path(spark, "category-model")
    model.write().save(path)
    return path


def loaded_model(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)
