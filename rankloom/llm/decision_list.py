"""Quality rules as a learned decision list.

Sequential covering: one rule after another is grown as a conjunction of
thresholds on text statistics (by FOIL's gain on two thirds of the labelled
rows), pruned on the remaining third, and kept while it is precise there; the
rows that it covers then leave. The list becomes one ordered Spark conditional.

Every labelled row counts. A growing step is one aggregation to at most
``features x (bins + 1)`` rows of counts, which is all the driver sees.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import SPACE, bound, words
from rankloom.session import written

# ---- fixed values -------------------------------------------------------
SYMBOLS = r"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # in a hundred words
WINDOW = 3
# ---- end of fixed values ------------------------------------------------

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "n_words", "mean_word", "symbols_per_word", "duplicate_lines", "repeated_words",
    "distinct_words", "upper_case", "marks_per_word",
)


def _count_of(text: Column, characters: str) -> Column:
    return F.char_length(F.regexp_replace(text, F.lit(f"[^{characters}]++"), F.lit("")))


def _repeated(w: Column) -> Column:
    """Words inside a window of three that occurs twice or more."""
    def covered(places: Column) -> Column:
        # Every place covers three words, fewer where the next one starts sooner.
        steps = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def twice(s: Column) -> Column:
        equal = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        same = F.filter(s, lambda x, i: equal(x, i - 1) | equal(x, i + 1))
        return bound(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]).alias("h"), i.alias("i")),
    )
    return bound(F.sort_array(windows), twice)


def statistics(text: Column) -> Column:
    """One struct of the statistics of a text, all longs; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeated(w).alias("n_repeat_words"),
        )

    def of_lines(rows: Column) -> Column:
        return F.struct(
            F.size(rows).cast("long").alias("n_lines"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        bound(words(t), of_words).alias("words"),
        bound(lines, of_lines).alias("lines"),
        _count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(t, r"\p{Lu}").cast("long").alias("n_upper"),
        _count_of(t, r"!?").cast("long").alias("n_marks"),
    )


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_base`` (the counted statistics) and ``_features`` (doubles)."""
    s = F.col("_s")
    n = F.greatest(s["words"]["n_words"], F.lit(1))
    ratio = lambda part, whole: (part / F.greatest(whole, F.lit(1))).cast("double")
    base = F.struct(
        s["words"]["n_words"].alias("n_words"), s["words"]["word_chars"].alias("word_chars"),
        s["n_symbols"].alias("n_symbols"), s["lines"]["n_dup_lines"].alias("n_dup_lines"),
        s["words"]["n_repeat_words"].alias("n_repeat_words"),
    )
    values = (
        s["words"]["n_words"].cast("double"), ratio(s["words"]["word_chars"], n),
        ratio(s["n_symbols"], n), ratio(s["lines"]["n_dup_lines"], s["lines"]["n_lines"]),
        ratio(s["words"]["n_repeat_words"], n), ratio(s["words"]["n_distinct"], n),
        ratio(s["n_upper"], s["words"]["word_chars"]), ratio(s["n_marks"], n),
    )
    features = F.struct(*[v.alias(name) for name, v in zip(FEATURES, values, strict=True)])
    return df.withColumn("_s", statistics(F.col(text))).withColumns({"_base": base, "_features": features}).drop("_s")


def base_failed(base: Column) -> Column:
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, features: Column) -> Column:
        value = features[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row that one covers is rejected, all others are kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self, features: Column) -> Column:
        verdict = None
        for rule in self.rules:
            covered = _all(rule, features)
            verdict = F.when(covered, False) if verdict is None else verdict.when(covered, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


def _all(rule: tuple[Condition, ...], features: Column) -> Column:
    return reduce(operator.and_, [c.column(features) for c in rule], F.lit(True))


def _counts(rows: DataFrame) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By feature: (bin, growing rejects, growing keeps, pruning rejects, pruning keeps)."""
    of = lambda prune, bad: F.count_if((F.col("prune") == prune) & (F.col("bad") == bad))
    counted = rows.select("prune", "bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(
        of(False, True).alias("gb"), of(False, False).alias("gg"),
        of(True, True).alias("pb"), of(True, False).alias("pg"),
    )
    by: dict[int, list] = {}
    for r in counted.collect():
        by.setdefault(r.f, []).append((r.bin, r.gb, r.gg, r.pb, r.pg))
    return {f: sorted(v) for f, v in by.items()}


def _best_step(counts: dict, cuts: list[list[float]], least: int):
    """The condition of the highest FOIL gain, with the counts of what it covers. Of
    equal gains the one that covers fewer kept rows of those held back."""
    best = None
    for f, bins in sorted(counts.items()):
        whole = [sum(b[k] for b in bins) for k in range(1, 5)]
        if not whole[0]:
            continue
        before = math.log2(whole[0] / (whole[0] + whole[1]))
        below = [0, 0, 0, 0]
        at = {b[0]: b[1:] for b in bins}
        for i, threshold in enumerate(cuts[f]):
            below = [a + b for a, b in zip(below, at.get(i, (0, 0, 0, 0)), strict=True)]
            for above in (False, True):
                got = [w - b for w, b in zip(whole, below, strict=True)] if above else list(below)
                if got[0] < least or got[:2] == whole[:2]:
                    continue
                gain = got[0] * (math.log2(got[0] / (got[0] + got[1])) - before)
                ahead = 1.0 if best is None else gain - best[0]
                if ahead > 1e-9 or ahead > -1e-9 and got[3] < best[2][3]:
                    best = (gain, Condition(FEATURES[f], above, threshold), got)
    return best if best and best[0] > 1e-9 else None


def learn(
    labelled: DataFrame,
    bins: int = 64,
    most_rules: int = 12,
    most_conditions: int = 4,
    least_covered: int = 5,
    precision: float = 0.8,
) -> DecisionList:
    """Fit on all rows of ``labelled``: ``doc_id``, ``bad`` (boolean) and ``_features``.

    Thresholds are the features' quantiles (``bins``, plus their spread among
    rejects). Rows with a null label or id are left out. Without rejects, or
    where no rule is precise enough, the list is empty and keeps all rows.
    What is equal in all counts goes to the earlier feature and lower threshold.
    """
    rows = labelled.where("bad is not null and doc_id is not null").select(
        "bad", (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).alias("prune"),
        F.array(*[F.col("_features")[f] for f in FEATURES]).alias("v"),
    )
    rows = written(rows, "rule-features")
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    quantiles = rows.agg(*[
        F.percentile_approx(F.when(where, F.col("v")[i]), at, 10_000).alias(f"{kind}{i}")
        for kind, where in (("a", F.lit(True)), ("b", F.col("bad"))) for i in range(len(FEATURES))
    ]).first()
    cuts = [sorted({*(quantiles[f"a{i}"] or []), *(quantiles[f"b{i}"] or [])}) for i in range(len(FEATURES))]
    if quantiles["b0"] is None:
        return DecisionList(())
    def bin_of(i: int) -> Column:
        value = F.col("v")[i]
        return F.size(F.filter(F.array(*map(F.lit, cuts[i])), lambda cut: cut < value))

    bin_list = F.array(*map(bin_of, range(len(FEATURES))))
    rows = written(rows.select("bad", "prune", bin_list.alias("bins")), "rule-bins")
    rules: list[tuple[Condition, ...]] = []
    left = rows

    def in_bins(c: Condition) -> Column:
        f = FEATURES.index(c.feature)
        return (F.col("bins")[f] > cuts[f].index(c.threshold)) == F.lit(c.above)

    while len(rules) < most_rules:
        rule: tuple[Condition, ...] = ()
        covers: list[list[int]] = []  # after each condition
        while len(rule) < most_conditions:
            step = _best_step(_counts(reduce(DataFrame.where, map(in_bins, rule), left)), cuts, least_covered)
            if step is None:
                break
            rule, covers = (*rule, step[1]), [*covers, step[2]]
            if step[2][1] == 0:
                break
        # Prune: the shortest head that does best on the rows held back.
        worth = [(pb - pg) / (pb + pg) if pb + pg else -1.0 for _, _, pb, pg in covers]
        if not worth:
            break
        keep = worth.index(max(worth)) + 1
        _, _, pb, pg = covers[keep - 1]
        if not pb or pb < precision * (pb + pg):
            break
        rules.append(rule[:keep])
        mask = reduce(operator.and_, [in_bins(c) for c in rule[:keep]])
        left = left.where(~mask)
    return DecisionList(tuple(rules))


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``_features``) that ``labels`` marks; an id
    marked twice counts as its lower quality."""
    marks = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return docs.select("doc_id", "_features").join(marks, "doc_id")


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``doc_id``, the counted statistics, ``base_failed`` and ``kept`` for every row.

    Null and empty texts have no words and fail. Repeated rows stay, each with
    the same verdict. Other columns of ``docs`` are not looked at. Without
    labels the base rules decide alone; no rows give no rows.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stats = written(with_statistics(narrow).drop("text"), "rule-statistics")
    rules = learn(labelled_features(stats, labels), **settings)
    failed = base_failed(F.col("_base"))
    return stats.select(
        "doc_id", *[F.col("_base")[c].alias(c) for c in BASE],
        failed.alias("base_failed"), (~failed & rules.keeps(F.col("_features"))).alias("kept"),
    )


def accepted(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their own columns.

    Every row is measured once and stored beside its statistics; the list is
    learned from the narrow columns, and texts are never shuffled.
    """
    measured = written(with_statistics(docs), "measured", compression="zstd")
    rules = learn(labelled_features(measured, labels), **settings)
    return measured.where(~base_failed(F.col("_base")) & rules.keeps(F.col("_features"))).select(*docs.columns)
