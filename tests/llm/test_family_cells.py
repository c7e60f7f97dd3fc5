"""Large buckets are compared block by block, with the links of all pairs and no row for each."""

from itertools import combinations

from pyspark.sql import functions as F

from rankloom.llm import one_permutation

N = 60


def _family(spark):
    """Texts that share a bucket and half of their words; neighbours 10, 11 and 40, 41 are near copies."""
    texts = {k: [f"w{i}" for i in range(50)] + [f"x{k}.{i}" for i in range(50)] for k in range(N)}
    for k in (10, 40):
        texts[k + 1] = [*texts[k][:-2], "y", "z"]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    keys = {k: [7, 1000 + k // 20] for k in range(N)} | {0: [7, 8], N: [8]}
    classes = docs.select(
        F.col("doc_id").alias("label"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.lit(97).cast("long").alias("n")
    ).join(spark.createDataFrame(list(keys.items()), "label long, keys array<long>"), "label")
    return docs, classes


def test_cells_find_the_links_of_all_pairs(spark):
    docs, classes = _family(spark)
    sets = one_permutation.full_sets(docs, classes.select("label", "_id", "_hash"), "doc_id", "text", 4)
    plain = {r.label: (set(r.keys), set(one_permutation.np.frombuffer(r.s, "<u8"))) for r in sets.join(classes.select("label", "keys"), "label").collect()}
    wanted = {
        (max(a, b), min(a, b)) for a, b in combinations(plain, 2)
        if plain[a][0] & plain[b][0] and 100 * len(plain[a][1] & plain[b][1]) >= 80 * len(plain[a][1] | plain[b][1])
    }
    buckets = classes.select("label", "n", F.col("label").alias("root"), F.explode("keys").alias("key"))
    for block in (7, 1000):
        found = one_permutation.family_links(buckets, sets, 80, block)
        assert {tuple(r) for r in found.collect()} == wanted == {(11, 10), (41, 40)}


def test_a_large_bucket_makes_no_row_for_each_pair(spark, monkeypatch):
    docs, classes = _family(spark)
    rows, confirmed = [], one_permutation.confirmed

    def counted(pairs, sets, percent):
        rows.append(pairs.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(one_permutation, "confirmed", counted)
    found = one_permutation.linked_classes(classes, docs, "doc_id", "text", 4, 80)
    assert {(r.label, r.root) for r in found.collect()} == {(10, 10), (11, 10), (40, 40), (41, 40)}
    assert sum(rows) < 16 * N


def test_members_of_large_buckets_are_selected_once(spark, monkeypatch):
    """What the families are made of is a stored table, not a join run again for each of its uses."""
    docs, classes = _family(spark)
    plans, family_links = [], one_permutation.family_links

    def seen(buckets, sets, percent):
        plans.append(buckets._jdf.queryExecution().optimizedPlan().toString())
        return family_links(buckets, sets, percent)

    monkeypatch.setattr(one_permutation, "family_links", seen)
    one_permutation.linked_classes(classes, docs, "doc_id", "text", 4, 80)
    assert plans and not any("Join" in plan for plan in plans)
