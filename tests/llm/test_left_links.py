"""Links that the stars leave out."""

from pyspark.sql import functions as F

from rankloom.llm import one_permutation


def test_links_beside_a_foreign_centre(spark):
    """The centre of the only shared bucket is linked with nobody, its other two are with each other."""
    words = [f"w{i}" for i in range(100)]
    texts = {1: words[:90], 2: words[:92], 3: [f"x{i}" for i in range(91)], 4: [f"y{i}" for i in range(91)]}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    keys = {1: [7], 2: [7], 3: [7, 8, 9], 4: [8, 9]}
    classes = docs.select(
        F.col("doc_id").alias("label"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"),
        (F.size(F.split("text", " ")) - 3).cast("long").alias("n"),
    ).join(spark.createDataFrame(list(keys.items()), "label long, keys array<long>"), "label")
    found = one_permutation.linked_classes(classes, docs, "doc_id", "text", 4, 80)
    assert {(r.label, r.root) for r in found.collect()} == {(1, 1), (2, 1)}
