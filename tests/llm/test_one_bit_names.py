"""Links of fingerprints in linear work."""

import random

from pyspark.sql import functions as F

from rankloom.llm import simhash


def test_links_grow_with_the_fingerprints(spark):
    """Not with the square of a group: each has 65 names, and a name's bearers are a chain."""
    rng = random.Random(3)
    prints = sorted({sum(1 << b for b in rng.sample(range(30), 2)) for _ in range(2000)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    links = simhash.links(df, 2, 10_000)
    assert links.count() <= 65 * len(prints)
    assert all(bin(a ^ b).count("1") <= 2 for a, b in links.collect())
    made = simhash.links(df.limit(60), 2)
    assert "explode(bs" not in made._jdf.queryExecution().optimizedPlan().toString()
    roots = simhash.components(df.withColumn("label", F.col("fingerprint")), links)
    assert roots.select("root").distinct().count() == 1
