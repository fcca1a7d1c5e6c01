"""Audit of how far the sources of a language diverge in their terms.

1. Duplicate texts collapse: identical texts of a language become one, with the
   number of times that each source holds it. What decides is a 128-bit digest; the
   texts themselves move once, the counts beside them.
2. Every text that is left is split into terms once. Its terms count for each of its
   sources as often as that source holds it, and its multiplicity is added to their
   document frequencies. Tasks add up before anything is shuffled.
3. Terms of enough documents are kept. A term's share of a group is a whole number of
   billionths, smoothed by one occurrence: a term that a group lacks has the group's
   floor share, which is the same for all of them.
4. Pairs are evaluated sparsely. A sum over all kept terms is the kept terms times the
   divergence of the two floors, plus corrections for the terms that either source
   has: those of one source depend on its share alone, so terms of equal share are
   one weighted row; those of both come from the term's own list of sources, added up
   within the task.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.bytetext import sub_batches
from alertloom.storage import fits, materialise

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000

# Everything but ASCII that is no letter.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
PART_CHARS = 1 << 20  # of a long text that are split at a time
HELD = 300_000  # sums that a task holds before it hands them on
CELLS = 1 << 20  # pairs of shares that are evaluated at a time


def text_terms(text: str) -> Counter[str]:
    """How often each term occurs in a text, A-Z in lower case."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if len(lower) <= PART_CHARS:
        return Counter(TERM.findall(lower))
    return Counter(found[0] for found in TERM.finditer(lower))


def collapse(rows: DataFrame) -> DataFrame:
    """lang, text, holders: each text of a language once, with (source, n) of its sources.

    rows: lang, source, text, none of them null. The first step combines within tasks,
    so a text of very many copies is no hot key; the number of its sources bounds the list.
    """
    keyed = rows.withColumn("digest", F.unhex(F.md5("text")))
    held = keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("holders"))
    texts = keyed.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(held, ["lang", "digest"]).select("lang", "text", "holders")


def count_terms(collapsed: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), added up within tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], dict[str, list[int]]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in sums.items():
                size = len(terms)
                flat = np.array(list(terms.values()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(terms), pa.string()), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["lang", "source", "term", "n", "docs"])
            sums.clear()

        for batch in sub_batches(batches, 1):
            for lang, text, holders in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = text_terms(text)
                if not found:
                    continue
                for holder in holders:
                    times = holder["n"]
                    own = sums.setdefault((lang, holder["source"]), {})
                    before = len(own)
                    for term, n in found.items():
                        known = own.get(term)
                        if known is None:
                            own[term] = [n * times, times]
                        else:
                            known[0] += n * times
                            known[1] += times
                    held += len(own) - before
                if held >= HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return collapsed.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), in decimals as the product may pass 64 bits."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, total.cast("decimal(20,0)")).cast("long")


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def both_sides(profiles: DataFrame) -> DataFrame:
    """lang, source, item, value: what terms of both sources add to each pair, beyond their floors.

    profiles: lang, shares (source, p, p0) of a term each. Sums are combined within
    tasks, so no pair of sources is shuffled per term.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        number: dict[str, int] = {}
        sums: dict[tuple[str, int], int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(sums)
            columns = [[k[0] for k in keys], [names[k[1] >> 32] for k in keys], [names[k[1] & 0xFFFFFFFF] for k in keys]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array([sums[k] for k in keys], pa.int64())], ["lang", "source", "item", "value"])
            sums.clear()

        for batch in batches:
            shapes: dict[tuple[str, int], list[list[dict]]] = {}
            for lang, shares in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shapes.setdefault((lang, len(shares)), []).append(shares)
            for (lang, width), lists in shapes.items():
                for source in {x["source"] for shares in lists for x in shares}:
                    if source not in number:
                        number[source] = len(names)
                        names.append(source)
                step = max(1, CELLS // (width * width))
                for at in range(0, len(lists), step):
                    some = lists[at : at + step]
                    who = np.array([[number[x["source"]] for x in shares] for shares in some], np.int64)
                    p, floor = (np.array([[x[name] for x in shares] for shares in some], np.int64) for name in ("p", "p0"))
                    a, b, a0, b0 = p[:, :, None], p[:, None, :], floor[:, :, None], floor[:, None, :]
                    of = lambda x, y: (x - y) ** 2 // y
                    value = of(a, b) - of(a, b0) - of(a0, b) + of(a0, b0)
                    keys = (who[:, :, None] << 32) | who[:, None, :]
                    apart = keys[:, ~np.eye(width, dtype=bool)].ravel()
                    found, place = np.unique(apart, return_inverse=True)
                    added = np.zeros(len(found), np.int64)
                    np.add.at(added, place, value[:, ~np.eye(width, dtype=bool)].ravel())
                    for key, x in zip(found.tolist(), added.tolist(), strict=True):
                        sums[lang, key] = sums.get((lang, key), 0) + x
                    if len(sums) >= HELD:
                        yield from flush()
        yield from flush()

    return profiles.where(F.size("shares") > 1).select("lang", "shares").mapInArrow(work, "lang string, source string, item string, value long")


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for docs (text, lang, source; other columns are not read).

    Part `pair`: item is another source of the language, value the sum over all kept
    terms of floor((p - q)^2 / q), p the source's shares and q the item's. Part `term`:
    item is a kept term that the source uses more than its language does, q the
    language's share; the `top_terms` largest. Ranks go by falling value, then by item.

    Null texts, languages and sources count as empty ones. A source without terms still
    has floor shares; in a language that keeps no term all pairs have value 0. Repeated
    rows count each. Empty tables give no rows.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    counted = count_terms(collapse(rows)).repartition("lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    listed = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("holders"))
    kept = materialise(listed.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n", "holders"), "kept-terms")

    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    used = kept.select("lang", F.inline("holders")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.join(languages, "lang", "left").join(used, ["lang", "source"], "left")
    sizes = sizes.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), (F.coalesce("total", F.lit(0)) + F.col("terms")).alias("mass"), (F.col("lang_total") + F.col("terms")).alias("lang_mass"))
    sizes = materialise(sizes.withColumn("p0", F.coalesce(share(F.lit(0), F.col("mass")), F.lit(1).cast("long"))), "source-sizes")
    beside = (lambda x: F.broadcast(x)) if fits(sizes) else (lambda x: x)

    shared = kept.select("lang", "term", "lang_n", F.inline("holders")).join(beside(sizes), ["lang", "source"])
    shared = shared.select("lang", "source", "term", share(F.col("n"), F.col("mass")).alias("p"), "p0", share(F.col("lang_n"), F.col("lang_mass")).alias("q"))
    terms = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", place).where(F.col("rank") <= top_terms)

    # Terms of one source: those of equal share are one row.
    alike = shared.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    other = sizes.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    met = alike.join(beside(other), "lang").where("source <> item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    ahead = met.select("lang", "source", "item", (F.col("n") * (excess(p, q0) - excess(p0, q0))).alias("value"))
    behind = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * (excess(q0, p) - excess(q0, p0))).alias("value"))
    floors = sizes.join(beside(other), "lang").where("source <> item").select("lang", "source", "item", (F.col("terms") * excess(p0, q0)).alias("value"))
    profiles = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("shares"))
    pairs = floors.union(ahead).union(behind).union(both_sides(profiles)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
    return pairs.union(terms)
