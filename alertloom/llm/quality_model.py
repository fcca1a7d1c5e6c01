"""Quality score by a sparse ensemble of rules.

Small trees are grown on statistics of labelled texts; every path from a root to a
node is a rule, a conjunction of threshold tests. A logistic model with an L1
penalty over the rules keeps a few dozen of them. The rules and their weights are
compiled into one column expression, so scoring is a plain projection.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.textstats import CLASSES, add_classes, add_lines, add_words, free_name
from alertloom.storage import materialise

TRAIN_ROWS = 20_000  # labelled rows that are learned from, about
TREES, DEPTH = 20, 3
PENALTY = 5e-4
SEED = 17

Test = tuple[int, bool, float]  # feature, True for <=, threshold

FEATURES = ["words_log", "mean_word", "distinct_words", "dup_lines", "words_per_line", "symbols", *[f"share_{c}" for c in CLASSES]]


def add_features(docs: DataFrame, text: str = "text", stats_col: str = "stats") -> DataFrame:
    """docs with the statistics that rules test, as a struct column of a name of its own.

    Shares of nothing are 0; a null text counts as empty. Columns of docs keep their
    names and values: the work is done beside them.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    rows = add_lines(add_classes(add_words(rows, "text"), "text"), "text")
    rows = rows.withColumn("n_distinct", F.size(F.array_distinct("words")))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    stats = {
        "words_log": F.log1p(F.col("n_words").cast("double")),
        "mean_word": over("word_chars", "n_words"),
        "distinct_words": over("n_distinct", "n_words"),
        "dup_lines": over("n_dup_lines", "n_lines"),
        "words_per_line": over("n_words", "n_lines"),
        "symbols": over("n_symbols", "word_chars"),
    } | {f"share_{c}": over(f"c_{c}", "n_chars") for c in CLASSES}
    return rows.select("row.*", F.struct(*[stats[name].alias(name) for name in FEATURES]).alias(stats_col))


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Test, ...], float]] = field(default_factory=list)

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for tests, weight in self.rules:
            total = total + F.when(holds(tests, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        said = [(" and ".join(f"{FEATURES[f]} {'<=' if low else '>'} {at:.6g}" for f, low, at in tests), weight) for tests, weight in self.rules]
        return [f"{weight:+.4f}  {text}" for text, weight in sorted(said, key=lambda x: -abs(x[1]))]


def holds(tests: tuple[Test, ...], stats: str = "stats") -> Column:
    out = None
    for feature, low, at in tests:
        value = F.col(stats)[FEATURES[feature]]
        test = value <= at if low else value > at
        out = test if out is None else out & test
    return out if out is not None else F.lit(True)


def simplify(tests: tuple[Test, ...]) -> tuple[Test, ...]:
    """The tightest test per feature and side, in a fixed order."""
    tightest: dict[tuple[int, bool], float] = {}
    for feature, low, at in tests:
        known = tightest.get((feature, low))
        tightest[feature, low] = at if known is None else min(known, at) if low else max(known, at)
    return tuple((f, low, at) for (f, low), at in sorted(tightest.items()))


def tree_rules(description: str) -> list[tuple[Test, ...]]:
    """Paths to all nodes but the roots, from the printed form of a forest."""
    found: dict[tuple[Test, ...], None] = {}
    path: list[Test] = []
    for line in description.splitlines():
        tested = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not tested:
            if "Tree" in line:
                path, base = [], len(line) - len(line.lstrip()) + 2
            continue
        depth = len(tested[1]) - base
        path = [*path[:depth], (int(tested[2]), tested[3] == "<=", float(tested[4]))]
        found[simplify(tuple(path))] = None
    # A split's two sides are complements: of single tests one side is enough.
    return [tests for tests in found if len(tests) > 1 or tests[0][1]]


def fit(labelled: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """A model from stats and label (0 or 1), one row each."""
    counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, all_rows = counts.get(1, 0), sum(counts.values())
    if len(counts) < 2:
        return RuleModel(math.log((ones + 1) / (all_rows - ones + 1)))
    features = labelled.select(F.col(label).cast("double").alias("label"), "stats", array_to_vector(F.array(*[F.col("stats")[n].cast("double") for n in FEATURES])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(features)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel(math.log(ones / (all_rows - ones)))
    marks = features.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(marks)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(float(lasso.intercept), [(r, w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleModel:
    """A model from labels (doc_id, quality) of docs (doc_id, text).

    About `rows` labelled ids are drawn by hash, so the side that is broadcast is
    bounded. Labels other than 0 and 1 and null ids are left out; equal labels of an id
    count once, so a document counts twice at most. Empty tables give a constant model.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("label")).distinct()
    share = min(1.0, rows / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < share)
    known = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # Written as the scan comes; only the few rows that were drawn are brought together.
    return fit(materialise(add_features(known).select("label", "stats"), "labelled-stats").repartition(4))


def score_quality(docs: DataFrame, model: RuleModel, text: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with a score (0 to 1, higher is better); a column of that name is replaced.

    Null and empty texts are scored by their statistics, which are 0; texts of any length
    are read whole; repeated rows are scored each; other columns keep their values,
    whatever their names; an empty table gives no rows.
    """
    kept = docs.drop(score_col)
    stats = free_name("stats_", [*docs.columns, score_col])
    return add_features(kept, text, stats).withColumn(score_col, model.score(stats)).drop(stats)
