"""Language identification by language-bitmask n-gram filters.

Every language has a Bloom filter of its characteristic byte 4-grams. The filters
are bit-sliced: a slot holds one bit per language (in planes of eight), so that
one look-up of an n-gram (the AND of its slots) gives the set of all languages
that contain it. A text's n-grams are counted by that set; the per-language
popcounts, less what each filter's fill would give by chance, decide.

An n-gram belongs to a language whose rate of it is at least DOMINANCE of the
highest rate of any language; the most frequent NGRAMS of them are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from alertloom.llm.bytetext import SLICE_BYTES, mix64, ragged, row_slices, sub_batches, text_bytes
from alertloom.llm.textstats import free_name
from alertloom.storage import materialise

UNKNOWN = "und"
SIZE = 4  # bytes of an n-gram
SLOTS = 1 << 19
PROBES = 3
NGRAMS = 20_000  # n-grams kept per language
DOMINANCE = 0.5
MIN_COUNT = 3
HELD_GRAMS = 1 << 17  # n-grams of all languages that a task counts before it hands them on
TRAIN_DOCS = 5_000  # expected documents per language that are learned from

# Letters keep their lower-case form, other ASCII becomes a space, all else stays.
_FOLD = np.array([b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def ngrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams that hold a letter byte, as numbers, and the n-grams before each text.

    Each text is read with a space before and after it.
    """
    sizes = np.diff(bounds)
    padded = np.full(len(data) + len(sizes) + 1, 0x20, np.uint32)
    padded[ragged(bounds[:-1] - bounds[0] + np.arange(1, len(sizes) + 1), sizes)] = _FOLD[data]
    grams = padded[: 1 - SIZE].copy()
    for k in range(1, SIZE):
        grams <<= np.uint32(8)
        grams |= padded[k : len(padded) - SIZE + 1 + k]
    begin = bounds - bounds[0] + np.arange(len(bounds))  # of the space before each text
    inside = np.ones(len(grams), bool)
    for k in range(1, SIZE - 1):  # those that would reach into the next text
        at = begin[1:] - k
        inside[at[(at >= 0) & (at < len(grams))]] = False
    inside &= grams != np.uint32(0x20202020)
    before = np.concatenate([[0], np.cumsum(inside)])
    return grams[inside], before[np.minimum(begin, len(grams))]


def _slots(grams: np.ndarray) -> np.ndarray:
    """PROBES slots of each n-gram, one row per probe."""
    mixed = mix64(grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    width = np.uint64(SLOTS.bit_length() - 1)
    return np.stack([((mixed >> (width * np.uint64(k))) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(PROBES)])


@dataclass(frozen=True)
class LanguageFilters:
    """languages: by falling share of the training texts; planes: eight languages each."""

    languages: list[str]
    planes: np.ndarray

    def chance(self) -> np.ndarray:
        """Rate of n-grams that each language's filter passes by chance."""
        bits = np.unpackbits(self.planes[..., None], axis=2, bitorder="little").mean(axis=1)
        return (bits.reshape(-1)[: len(self.languages)]) ** PROBES

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text that each language contains (texts x languages), and all."""
        grams, before = ngrams(data, bounds)
        rows, slots = np.repeat(np.arange(len(bounds) - 1), np.diff(before)), _slots(grams)
        every = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        found = []
        for plane in self.planes:
            sets = plane[slots[0]]
            for probe in slots[1:]:
                sets &= plane[probe]
            found.append(np.bincount(rows * 256 + sets, minlength=(len(bounds) - 1) * 256).reshape(-1, 256) @ every)
        return np.concatenate(found, axis=1)[:, : len(self.languages)], np.diff(before)

    def decide(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language of each text, its share of all corrected hits, and
        the share of the text's n-grams that those of the best language are."""
        best, share, covered = [], [], []
        chance = self.chance()
        for a, b in row_slices(bounds):
            edges = bounds[a : b + 1]
            if b - a == 1 and edges[1] - edges[0] > 1 << 20:
                found, total = self._long(data, int(edges[0]), int(edges[1]))
            else:
                found, total = self.counts(data[edges[0] : edges[-1]], edges)
            hits = np.maximum(0.0, (found - total[:, None] * chance) / (1 - chance))
            best.append(hits.argmax(axis=1))
            sums = hits.sum(axis=1)
            share.append(np.divide(hits.max(axis=1), sums, out=np.zeros(len(sums)), where=sums > 0))
            covered.append(np.divide(hits.max(axis=1), total, out=np.zeros(len(sums)), where=total > 0))
        none = np.zeros(0)
        return tuple(np.concatenate(x) if x else none.astype(kind) for x, kind in ((best, np.int64), (share, float), (covered, float)))

    def _long(self, data: np.ndarray, start: int, end: int, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """One long text in parts; the few n-grams across a cut see a space there."""
        parts = [self.counts(data[a : min(a + step, end)], np.array([0, min(step, end - a)])) for a in range(start, end, step)]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)


def _gram_counts(batch: pa.RecordBatch, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each language, as language number << 32 | n-gram, and how often each occurs."""
    names = batch.column(0).cast(pa.string()).to_pylist()
    data, bounds = text_bytes(batch.column(1))
    grams, before = ngrams(data, bounds)
    owner = np.array([number.setdefault(n, len(number)) for n in names], np.uint64)
    return np.unique(np.repeat(owner << np.uint64(32), np.diff(before)) | grams, return_counts=True)


def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the texts in batches of (lang, text); a pair may come several times."""
    number: dict[str, int] = {}
    pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counted() -> pa.RecordBatch:
        which = (pairs >> np.uint64(32)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()).take(pa.array(which)), pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    # A slice at a time: arrays for all n-grams of a slice are many times its size.
    for batch in sub_batches(batches, 1, SLICE_BYTES):
        own, more = _gram_counts(batch, number)
        pairs, place = np.unique(np.concatenate([pairs, own]), return_inverse=True)
        added = np.zeros(len(pairs), np.int64)
        np.add.at(added, place, np.concatenate([counts, more]))
        counts = added
        if len(pairs) > HELD_GRAMS:
            yield counted()
            pairs, counts = pairs[:0], counts[:0]
    if len(pairs):
        yield counted()


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> LanguageFilters:
    """Filters from a sample of about train_docs texts per language, chosen by id hash.

    Rows with a null text or language are left out. What reaches the driver are the
    languages and the set slots, at most SLOTS a plane.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = [r["lang"] for r in known]
    planes = np.zeros((max(1, -(-len(languages) // 8)), SLOTS), np.uint8)
    if not languages:
        return LanguageFilters([], planes)
    share = F.create_map(*[x for r in known for x in (F.lit(r["lang"]), F.lit(min(1.0, train_docs / r["n"])))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(drawn < F.element_at(share, F.col("lang"))).select("lang", "text")

    counts = materialise(sample.mapInArrow(gram_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngram-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    sums = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(float(totals.get(name, 1))))])
    rated = counts.withColumn("rate", F.col("n") / F.element_at(sums, F.col("lang")))
    rated = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where((F.col("n") >= MIN_COUNT) & (F.col("rate") >= DOMINANCE * F.col("top")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = rated.withColumn("place", place).where(F.col("place") <= NGRAMS).select("lang", "gram")
    index = spark.sparkContext.broadcast({name: k for k, name in enumerate(languages)})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.array([index.value[n] for n in batch.column(0).to_pylist()], np.int64)
            slots = _slots(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64))
            plane, mask = np.tile(number // 8, PROBES), np.tile(1 << (number % 8), PROBES)
            yield pa.RecordBatch.from_arrays([pa.array(plane), pa.array(slots.ravel()), pa.array(mask)], ["plane", "slot", "mask"])

    filled = kept.mapInArrow(fill, "plane long, slot long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").cast("int").alias("mask"))
    for row in filled.toLocalIterator():
        planes[row["plane"], row["slot"]] = row["mask"]
    return LanguageFilters(languages, planes)


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score", coverage_col: str | None = None) -> DataFrame:
    """docs with a language and a score; columns of those two names are replaced.

    coverage_col, if given, gets the share of the text's n-grams that are of the language
    beyond the chance rate: near 0 in a language that was not learned.

    `und` with score 0: the text is null or has no letter, or nothing was learned.
    A text none of whose n-grams is known gets the most frequent language, score 0.
    Texts of any length are read whole; repeated rows are judged each; other columns keep
    their values, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cover = coverage_col or free_name("coverage_", [*docs.columns, pred_col, score_col])
    mark = free_name("has_letter_", [*docs.columns, pred_col, score_col, cover])
    shared = spark.sparkContext.broadcast(filters)
    kept = [f for f in docs.schema.fields if f.name not in (pred_col, score_col, coverage_col)]
    names = [f.name for f in kept]
    schema = StructType([*kept, StructField(pred_col, StringType()), StructField(score_col, DoubleType()), StructField(cover, DoubleType()), StructField(mark, BooleanType())])
    place = names.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = pa.array([*model.languages, UNKNOWN], pa.string())
        for batch in sub_batches(batches, place):
            letters = batch.column(len(names))
            data, bounds = text_bytes(batch.column(place))
            nothing = np.zeros(batch.num_rows)
            best, share, covered = model.decide(data, bounds) if model.languages else (nothing.astype(np.int64), nothing, nothing)
            void = ~letters.to_numpy(zero_copy_only=False).astype(bool)
            best, share = np.where(void, len(model.languages), best), np.where(void, 0.0, share)
            covered = np.where(void, 0.0, covered)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], known.take(pa.array(best)), pa.array(share), pa.array(covered), letters], [*names, pred_col, score_col, cover, mark])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*names, letter.alias(mark)).mapInArrow(judge, schema).drop(mark, *([] if coverage_col else [cover]))

