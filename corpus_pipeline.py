"""Corpus pipeline: language, quality, near duplicates, mixing, packing.

STAGES are (name, function) pairs. A function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's docs.
All but the last return the columns of docs; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import langid, mixing, neardup, packing, quality_model
from alertloom.llm.wordbpe import default_path
from alertloom.session import ship_package
from alertloom.storage import scratch_path

# Shares of corrected n-gram hits below this are no language that was learned.
LEAST_LANGUAGE_SCORE = 0.3
# Of the n-grams of a text, those of its language beyond the chance rate; texts of a
# language that was learned have twice this and more, others about half of it at most.
LEAST_COVERAGE = 0.25
LEAST_QUALITY = 0.3
SHINGLE_WORDS = 5
MIX = mixing.Mix(budget_share=0.9, entropy_gain=0.5, max_repeats=1.0)


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """The rows of docs that `keep` holds for, once `judge` has added its columns to the texts.

    The other columns ride along in a struct, so no name of theirs meets one of the judge's.
    keep also reads a random column: a filter with one is not moved below the projection,
    where it would work out every statistic anew for each of its uses.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("others"), "text")
    kept = judge(rows).withColumn("pin", F.rand(1)).where(keep & (F.col("pin") >= 0))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"others.{c}").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in no known language.

    A language is known if it has enough of the hits, and the text enough hits at all.
    Null and empty texts are rejected; repeated rows and ids are judged each; texts of any
    length are read whole; an empty table stays empty.
    """
    ship_package(spark)
    filters = langid.train(docs)
    known = (F.col("language") != langid.UNKNOWN) & (F.col("language_score") >= LEAST_LANGUAGE_SCORE) & (F.col("coverage") >= LEAST_COVERAGE)
    return _judged(docs, lambda rows: langid.identify(rows, filters, pred_col="language", score_col="language_score", coverage_col="coverage"), known)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the rule ensemble scores low.

    Empty texts are scored as such; rows with a null or repeated id are judged each by
    their own text; without labels all documents get the same score.
    """
    ship_package(spark)
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda rows: quality_model.score_quality(rows, model, score_col="quality_score"), F.col("quality_score") >= LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    Empty texts and rows without an id are kept; rows that repeat a kept id stay, since
    they are one document.
    """
    ship_package(spark)
    dropped = neardup.near_duplicates(docs, SHINGLE_WORDS).where(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"))
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts sources down to tempered weights; rows come in block order.

    Sources without tokens are left out; null ids and sources count as values.
    """
    ship_package(spark)
    return mixing.mixed_documents(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed each.
    """
    ship_package(spark)
    return packing.pack_texts(docs, default_path())


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

# Learned classifiers, MinHash groups and BPE packing cannot be said in SQL; the
# tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
