"""Quality rules by distribution divergence, in column expressions only.

Base rules look at length and repetition. Texts that pass are compared with
language references by Jensen-Shannon distance: the shares of character classes,
and the shares of the language's common words (all other words are one bin). A
text fails if even its nearest reference is too far, where it is long enough for
its own shares to mean something. References come from all documents that name a
language; those with too few words give none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.textstats import CLASSES, add_classes, add_lines, add_repeats, add_words, let
from alertloom.storage import materialise

COMMON = 32  # common words of a reference


@dataclass(frozen=True)
class Bounds:
    min_words: int = 20
    max_repeat_percent: int = 30
    class_chars: int = 200  # shorter texts are not held against class shares
    word_words: int = 50  # nor shorter ones than this against word shares
    class_distance: float = 0.27
    word_distance: float = 0.45
    reference_words: int = 1_000  # a language with fewer has no reference


def divergence_term(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence in bits."""
    half = F.lit(0.5)
    of = lambda a: F.when(a > 0, half * a * F.log2(a * 2 / (p + q))).otherwise(F.lit(0.0))
    return of(p) + of(q)


def distance(pairs: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of an array of (p, q) bins."""
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + divergence_term(x["p"], x["q"]))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def candidate_words(docs: DataFrame, text: str, lang: str, common: int = COMMON) -> list[str]:
    """The most frequent words of each language, counted over all its texts."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    words = add_words(rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")), "text").select("lang", F.explode("words").alias("word"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place).where(F.col("place") <= common)
    return sorted(r["word"] for r in top.select("word").distinct().collect())


def run_lengths(items: Column) -> Column:
    """Distinct items with their counts, from an array in any order."""

    def of(ranked: Column) -> Column:
        places = F.array_compact(F.transform(ranked, lambda x, k: F.when((k == 0) | (F.get(ranked, k - 1) != x), k)))
        return let(places, lambda at: F.transform(at, lambda p, k: F.struct(F.get(ranked, p).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(ranked)) - p).cast("long").alias("n"))))

    return let(F.array_sort(items), of)


def measure(docs: DataFrame, candidates: list[str], text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row of figures per document: base figures, class counts, candidate-word counts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = add_repeats(add_lines(add_classes(add_words(rows, "text"), "text"), "text"))
    common = F.filter("words", lambda w: w.isin(candidates)) if candidates else F.array().cast("array<string>")
    return rows.withColumn("common", run_lengths(common)).drop("text", "words")


def references(figures: DataFrame, bounds: Bounds, common: int = COMMON) -> list[dict]:
    """Per language: class shares, and its common words with their shares, over all documents."""
    named = figures.where(F.col("lang").isNotNull())
    sums = named.groupBy("lang").agg(F.sum("n_words").alias("n_words"), *[F.sum(f"c_{c}").alias(c) for c in CLASSES]).where(F.col("n_words") >= bounds.reference_words)
    counts = named.select("lang", F.explode("common").alias("c")).groupBy("lang", F.col("c.word").alias("word")).agg(F.sum("c.n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top: dict[str, list] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= common).orderBy("lang", "place").collect():
        top.setdefault(r["lang"], []).append((r["word"], r["n"]))
    made = []
    for r in sums.orderBy("lang").collect():
        chars = sum(r[c] for c in CLASSES)
        words = [(w, n / r["n_words"]) for w, n in top.get(r["lang"], [])]
        made.append({"lang": r["lang"], "classes": [r[c] / chars for c in CLASSES], "words": words})
    return made


def class_distance(reference: dict) -> Column:
    pairs = [F.struct((F.col(f"c_{c}") / F.col("n_chars")).alias("p"), F.lit(float(q)).alias("q")) for c, q in zip(CLASSES, reference["classes"], strict=True)]
    return F.when(F.col("n_chars") > 0, distance(F.array(*pairs)))


def word_distance(reference: dict) -> Column:
    """Over the reference's common words and one bin for all other words."""
    if not reference["words"]:
        return F.lit(None).cast("double")
    listed = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(float(q)).alias("q")) for w, q in reference["words"]])
    rest = 1.0 - sum(q for _, q in reference["words"])

    def of(counts: Column) -> Column:
        pairs = F.transform(listed, lambda x: F.struct((F.coalesce(F.element_at(counts, x["word"]), F.lit(0)) / F.col("n_words")).alias("p"), x["q"].alias("q")))
        return let(pairs, lambda known: distance(F.array_append(known, F.struct((F.lit(1.0) - F.aggregate(known, F.lit(0.0), lambda a, x: a + x["p"])).alias("p"), F.lit(rest).alias("q")))))

    return F.when(F.col("n_words") > 0, let(F.map_from_arrays("common.word", "common.n"), of))


def judge(figures: DataFrame, made: list[dict], bounds: Bounds) -> DataFrame:
    """figures with base_failed, class_js, word_js (distance to the nearest reference) and kept."""
    nearest = lambda each: F.array_min(F.array(*[each(r) for r in made])) if made else F.lit(None).cast("double")
    failed = (F.col("n_words") < bounds.min_words) | (100 * F.col("n_repeat_words") > bounds.max_repeat_percent * F.col("n_words"))
    df = figures.withColumns({"base_failed": failed, "class_js": F.round(nearest(class_distance), 6), "word_js": F.round(nearest(word_distance), 6)})
    odd_classes = (F.col("n_chars") >= bounds.class_chars) & (F.col("class_js") > bounds.class_distance)
    odd_words = (F.col("n_words") >= bounds.word_words) & (F.col("word_js") > bounds.word_distance)
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd_classes, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False)))


def quality_rules(docs: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, lang; other columns are not read).

    A null text counts as empty and fails the base rules. Rows with a null language
    are judged, but are no part of a reference; repeated rows and ids are judged
    each. Without any reference only the base rules decide.
    """
    bounds = bounds or Bounds()
    candidates = candidate_words(docs, "text", "lang")
    figures = materialise(measure(docs, candidates), "text-figures")
    return judge(figures, references(figures, bounds), bounds)
