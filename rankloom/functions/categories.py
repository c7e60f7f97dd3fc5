"""Job categories, difficulty buckets and question weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
CATEGORIES = (
    "AI / Machine Learning",
    "Backend Development",
    "Cybersecurity",
    "DevOps / Cloud Engineering",
    "Frontend Development",
    "Mobile Development",
    "QA / Test Engineering",
)
WEIGHTS_DDL = "category string, question_type string, weight double"
WEIGHTS = (
    # category, code, objective, mcq, subjective
    ("datascience", 0.40, 0.30, 0.13, 0.17),
    ("software developer", 0.50, 0.30, 0.10, 0.10),
    ("cybersecurity specialist", 0.48, 0.28, 0.14, 0.10),
    ("devops engineer", 0.42, 0.30, 0.18, 0.10),
    ("graphics engineer", 0.30, 0.20, 0.20, 0.30),
    ("machine learning engineer", 0.47, 0.28, 0.10, 0.15),
    ("robotics engineer", 0.46, 0.29, 0.10, 0.15),
)
QUESTION_TYPES = ("code", "objective", "mcq", "subjective")
BASIC_YEARS, INTERMEDIATE_YEARS = 2, 5
# ---- end of fixed values ------------------------------------------------


def weights_dim(spark: SparkSession, weights=WEIGHTS) -> DataFrame:
    """Weight per category and question type; each category must sum to one."""
    rows = []
    for category, *values in weights:
        if abs(sum(values) - 1.0) > 1e-9:
            raise ValueError(f"weights of {category!r} do not sum to 1")
        rows += [(category, kind, w) for kind, w in zip(QUESTION_TYPES, values, strict=True)]
    return spark.createDataFrame(rows, WEIGHTS_DDL)


def title_category(label: Column, categories=CATEGORIES) -> Column:
    """Exact category; else the first one that contains the label or is
    contained in it, ignoring case; else the label itself."""
    low = F.lower(label)
    found = F.when(label.isin(*categories), label)
    for name in categories:
        found = found.when(low.contains(name.lower()) | F.lit(name.lower()).contains(low), F.lit(name))
    return found.otherwise(label)


def experience_bucket(years: Column) -> Column:
    return (
        F.when(years <= BASIC_YEARS, "basic")
        .when(years <= INTERMEDIATE_YEARS, "intermediate")
        .when(years.isNotNull(), "hard")
    )


def label_decode(prediction: Column, categories=CATEGORIES) -> Column:
    """Category name of a numeric prediction; an unknown number is an error."""
    names = F.array(*[F.lit(c) for c in categories])
    number = prediction.cast("int")
    known = (number >= 0) & (number < len(categories))
    return F.when(known, F.get(names, number)).when(
        number.isNotNull(),
        F.raise_error(F.concat(F.lit("unknown category number "), number.cast("string"))),
    )
