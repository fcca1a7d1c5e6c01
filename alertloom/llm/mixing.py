"""Mixing sources to target weights by temperature, in DataFrame operations only.

Source weights are token shares raised to an exponent between 0 (uniform) and 1
(natural) and normalised. The exponent is found by bisection: the largest that
reaches a target entropy, or, if that would repeat a source too often, the
smallest that stays within the repetition limit.

The weights are then realised as block permutations. A source's stream is its
documents in a pseudo-random order, a fresh one for each repetition, up to the
source's token budget. The streams are cut at equal parts of their budgets, and
the n-th parts of all sources make up block n, in a shuffled order. So every block
has the target weights, up to the size of a document.

Places in a stream are running sums. They are made in three levels (documents in a
fine bucket, fine buckets in a coarse one, coarse ones in a source), so that no
source, however large, is ordered by one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.textstats import free_name, words_of
from alertloom.storage import materialise

FINE_ROWS = 500  # documents of a fine bucket, about
COARSE_BUCKETS = 1_000  # fine buckets of a coarse one
PROBES = 15  # exponents tried in one pass over the sources
PASSES = 8
DIGITS = 1_000_000  # exponents are rounded up to six decimals


@dataclass(frozen=True)
class Mix:
    budget_share: float = 1.0  # tokens of the result, as a share of the tokens there are
    entropy_gain: float = 0.5  # target entropy: so far from the natural one to that of equal weights
    max_repeats: float = 4.0  # a source is used so often at most
    block_tokens: int = 1_000_000
    seed: int = 1


def token_counts(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source, n_tokens: words of the whole text (null: none)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("n_tokens"))


def _bisect(sources: DataFrame, holds: Callable[[float], Column], rising: bool) -> float:
    """The end of the range of exponents in [0, 1] for which `holds` does.

    rising: it holds from some exponent up, else up to some exponent. Every pass
    tries several inner points at once, which is as many halvings.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        points = [low + (high - low) * k / (PROBES + 1) for k in range(1, PROBES + 1)]
        row = sources.agg(*[holds(p).alias(f"p{k}") for k, p in enumerate(points)]).first()
        good = [p for k, p in enumerate(points) if row[k]]
        bad = [p for k, p in enumerate(points) if not row[k]]
        low, high = (max([low, *bad]), min([high, *good])) if rising else (max([low, *good]), min([high, *bad]))
    return high if rising else low


def find_exponent(sources: DataFrame, mix: Mix) -> float:
    """sources: log_share of every source with tokens."""
    x = F.col("log_share")
    row = sources.agg(F.count(F.lit(1)).alias("n"), (-F.sum(F.exp(x) * x)).alias("natural")).first()
    if not row["n"]:
        return 1.0
    target = row["natural"] + mix.entropy_gain * max(0.0, math.log(row["n"]) - row["natural"])

    def varied(a: float) -> Column:
        z = F.sum(F.exp(F.lit(a) * x))
        return F.log(z) - F.lit(a) * F.sum(F.exp(F.lit(a) * x) * x) / z >= F.lit(target)

    def modest(a: float) -> Column:
        return F.max(F.exp(F.lit(a - 1.0) * x)) / F.sum(F.exp(F.lit(a) * x)) * F.lit(mix.budget_share) <= F.lit(mix.max_repeats)

    by_entropy = math.floor(_bisect(sources, varied, rising=False) * DIGITS) / DIGITS
    if sources.agg(modest(by_entropy)).first()[0]:
        return by_entropy
    return min(1.0, math.ceil(_bisect(sources, modest, rising=True) * DIGITS) / DIGITS)


def source_budgets(sizes: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """source, tokens, docs, budget, repeats; and the number of blocks.

    Sources without tokens are left out. A null source is a source of its own.
    """
    if mix.budget_share > mix.max_repeats:
        raise ValueError("the budget asks for more repetitions than are allowed")
    sums = materialise(sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).where("tokens > 0"), "source-sums")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    budget = int(total * mix.budget_share)
    shares = sums.withColumn("log_share", F.log(F.col("tokens") / F.lit(float(max(1, total)))))
    exponent = find_exponent(shares, mix)
    scale = shares.agg(F.sum(F.exp(F.lit(exponent) * F.col("log_share")))).first()[0] or 1.0
    weight = F.exp(F.lit(exponent) * F.col("log_share")) / F.lit(scale)
    planned = shares.withColumn("budget", F.floor(weight * F.lit(float(budget))).cast("long"))
    planned = planned.withColumn("repeats", F.ceil(F.col("budget") / F.col("tokens")).cast("int")).where("budget > 0")
    return planned.select("source", "tokens", "docs", "budget", "repeats"), max(1, -(-budget // mix.block_tokens))


def realise(sizes: DataFrame, budgets: DataFrame, blocks: int, seed: int) -> DataFrame:
    """doc_id, source, n_tokens, epoch, stream_start, block, order_key: a row per use of a document.

    order_key orders the rows of a block. The document that crosses the end of a
    budget is still used.
    """
    plan = budgets.withColumnRenamed("source", "plan_source")
    joined = sizes.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    uses = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    uses = uses.withColumn("order_key", key)
    # The first 48 bits of the key place it in a bucket, so buckets follow key order.
    drawn = F.conv(F.substring("order_key", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    uses = uses.withColumn("fine", F.floor(drawn * F.ceil(F.col("docs") / FINE_ROWS)).cast("long"))
    group = ["source", "epoch", "fine"]
    before = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*group).orderBy("order_key", "doc_id", "n_tokens").rowsBetween(*before)
    placed = uses.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    fine = uses.groupBy(*group).agg(F.sum("n_tokens").alias("n"))
    fine = materialise(fine.withColumn("coarse", F.floor(F.col("fine") / COARSE_BUCKETS).cast("long")), "fine-sums")
    in_coarse = Window.partitionBy("source", "epoch", "coarse").orderBy("fine").rowsBetween(*before)
    in_source = Window.partitionBy("source", "epoch").orderBy("coarse").rowsBetween(*before)
    coarse = fine.groupBy("source", "epoch", "coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.select("source", "epoch", "coarse", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("above"))
    fine = fine.withColumn("beside", F.coalesce(F.sum("n").over(in_coarse), F.lit(0)))
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    offsets = fine.join(coarse, same(fine, coarse, ["source", "epoch", "coarse"])).select(*[fine[c].alias(f"o_{c}") for c in group], (F.col("above") + F.col("beside")).alias("offset"))
    found = placed.join(offsets, [placed[c].eqNullSafe(offsets[f"o_{c}"]) for c in group])
    found = found.withColumn("stream_start", F.col("epoch") * F.col("tokens") + F.col("offset") + F.col("inside")).where("stream_start < budget")
    block = F.expr(f"cast(stream_start * {blocks}L div budget as bigint)")
    return found.select("doc_id", "source", "n_tokens", "epoch", "stream_start", block.alias("block"), "order_key")


def mix_sources(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """A row per use of a document of docs (doc_id, text, source; other columns are not read).

    A null text has no tokens; such documents follow their source's stream without
    using budget, and are left out where the whole source has no tokens. Rows that
    repeat an id are mixed each, in the same place of the order.
    """
    mix = mix or Mix()
    sizes = materialise(token_counts(docs), "token-counts")
    budgets, blocks = source_budgets(sizes, mix)
    return realise(sizes, materialise(budgets, "budgets"), blocks, mix.seed)


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The chosen documents with their own columns, written in block order.

    For mixes that use a document once at most (max_repeats up to 1). Rows that
    repeat an id come along if one of them is chosen.
    """
    if mix.max_repeats > 1:
        raise ValueError("documents would repeat")
    names = [free_name(n, docs.columns) for n in ("chosen_id", "chosen_block", "chosen_key")]
    chosen = mix_sources(docs, mix).groupBy(F.col("doc_id").alias(names[0])).agg(F.min("block").alias(names[1]), F.min("order_key").alias(names[2]))
    chosen = materialise(chosen, "chosen")
    joined = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[names[0]]))
    ordered = joined.repartitionByRange(*names[1:]).sortWithinPartitions(*names[1:])
    return ordered.select(*docs.columns)
