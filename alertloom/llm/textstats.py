"""Statistics of whole texts as column expressions.

Every text stays in its row: words and lines are arrays, nothing is exploded. A
null text counts as empty. `text_stats` adds the columns; later ones build on
earlier ones, so that costly arrays are made once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
WINDOW = 8
CLASSES = ["lower", "space", "beyond", "upper", "digit", "other"]


def free_name(name: str, taken: list[str]) -> str:
    """`name`, made longer until no column has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once per row.

    The optimiser may put the expression behind a column in the place of the column,
    also inside a lambda, where it would run once per element. A lambda's own
    variable is safe from that.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The runs of `[^\\x20\\x09-\\x0D]` in turn."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the 8-word windows in turn."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    return let(words, of)


def repeated_places(windows: Column) -> Column:
    """Places of the windows whose hash occurs at least twice, ascending."""

    def same(ranked: Column) -> Column:
        # Sorted by hash, equal windows are neighbours.
        return F.transform(ranked, lambda x, k: F.when((F.get(ranked, k - 1)["h"] == x["h"]) | (F.get(ranked, k + 1)["h"] == x["h"]), x["i"]))

    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.array_sort(F.array_compact(let(ranked, same)))


def covered(places: Column) -> Column:
    """Words covered by windows that start at these places."""
    steps = let(places, lambda at: F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)


def repeated_words(windows: Column) -> Column:
    """Words in windows found at least twice. Texts whose windows all differ, which are most, need no sorting."""
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(repeated_places(w))).otherwise(F.lit(0).cast("long")))


def add_words(df: DataFrame, text: str) -> DataFrame:
    """words (array) and n_words."""
    df = df.withColumn("words", words_of(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("n_words", F.size("words").cast("long"))


def add_classes(df: DataFrame, text: str) -> DataFrame:
    """n_chars, characters by class (c_<class>), word_chars and n_symbols.

    Each class is stripped from what the one before left, so only the first pass
    reads the whole text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("n_chars", F.length(whole).cast("long")).withColumn("left_0", F.regexp_replace(whole, "[a-z]+", ""))
    patterns = [WORD_BREAK, r"[^\x00-\x7F]+", "[A-Z]+", "[0-9]+"]
    for k, pattern in enumerate(patterns):
        df = df.withColumn(f"left_{k + 1}", F.regexp_replace(f"left_{k}", pattern, ""))
    sizes = [F.col("n_chars"), *[F.length(f"left_{k}").cast("long") for k in range(len(patterns) + 1)], F.lit(0).cast("long")]
    df = df.withColumns({f"c_{name}": sizes[k] - sizes[k + 1] for k, name in enumerate(CLASSES)})
    symbols = F.length(f"left_{len(patterns)}") - F.length(F.regexp_replace(f"left_{len(patterns)}", "[#*$%&|<>]+", ""))
    df = df.withColumns({"word_chars": F.col("n_chars") - F.col("c_space"), "n_symbols": symbols.cast("long")})
    return df.drop(*[f"left_{k}" for k in range(len(patterns) + 1)])


def add_lines(df: DataFrame, text: str) -> DataFrame:
    """n_lines (lines with a word) and n_dup_lines (those equal to an earlier one)."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    sizes = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    df = df.withColumn("line_sizes", sizes)
    return df.withColumns({"n_lines": F.col("line_sizes.n").cast("long"), "n_dup_lines": (F.col("line_sizes.n") - F.col("line_sizes.d")).cast("long")}).drop("line_sizes")


def add_repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words, from words: words in 8-word windows found at least twice.

    Windows are compared by 64-bit hashes.
    """
    return df.withColumn("n_repeat_words", repeated_words(window_hashes(F.col("words"))))
