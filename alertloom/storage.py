"""Shared scratch space, lineage cuts and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side with at most this many rows may be broadcast; beyond it the
# shuffle path is taken.
BROADCAST_ROWS = 200_000

# Folders written by materialise, in turn, for `scratch` to remove.
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by spark.checkpoint.dir.

    Only where the session names none and everything runs on one machine (tests) a
    temporary folder is made and remembered in the session settings; elsewhere
    executors could not see each other's files there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("alertloom.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="alertloom-")
        spark.conf.set("alertloom.scratch", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write once, reread many times: a parquet table in the shared scratch folder.

    Cuts the lineage after costly steps (model scoring, frequency counts) whose
    result feeds several jobs. The copy outlives lost executors, unlike cached
    blocks, and later passes read only the columns they need.
    """
    path = scratch_path(df.sparkSession, label)
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for costly work on each of them.

    A table of few bytes is read in few tasks, however many rows it holds. Large
    ones are dealt into as many parts as their size asks for.
    """
    return df.hint("rebalance")


def fits(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when df has at most `limit` rows; stops reading once past it."""
    return df.limit(limit + 1).agg(F.count(F.lit(1))).first()[0] <= limit


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the copies made inside the block when it ends.

    For jobs whose results are stored elsewhere; a frame that still reads a copy
    must not leave the block.
    """
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        del _made[before:]
