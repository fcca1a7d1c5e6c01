"""Token ids as length-delimited binary records with a separate offset index.

File format (that of the common training-record files): a record is its payload
length (unsigned 64 bit), the masked CRC-32C of that length, the payload, and the
masked CRC-32C of the payload, all little-endian. Payload: a flag word (1: the
document has an id; 2: ids of 32 bit), the document id (64 bit), the number of
token ids, and the ids, of 16 bit each where the vocabulary allows it and else of
32, filled up with zeros to whole words.
The index of a file has two 64-bit numbers for each record and for the end: the
byte offset and the ids before it, so that any record is found by number without
reading those before it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.llm.bytetext import ragged, sub_batches
from alertloom.llm.checksums import crc32c, masked
from alertloom.llm.files import RangeReader, create
from alertloom.llm.wordbpe import END_ID, encode_with_end, encoder
from alertloom.storage import materialise, scratch_path

HEAD = 3  # words before the payload
META = 4  # words of the payload before the ids
RECORDS_PER_READ = 2048

MANIFEST = "part int, path string, index_path string, records long, tokens long, bytes long"
FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long, path string, byte_offset long"


def _without(words: int, first: np.ndarray, lead: int, last: np.ndarray) -> np.ndarray:
    """Mask of all words but the `lead` first and the last of each record."""
    mask = np.ones(words, bool)
    for k in range(lead):
        mask[first + k] = False
    mask[last] = False
    return mask


def _halves(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = number.astype(np.uint64)
    return (number & np.uint64(0xFFFFFFFF)).astype(np.uint32), (number >> np.uint64(32)).astype(np.uint32)


def frame_records(ids: np.ndarray, bounds: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, wide: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Framed records as 32-bit words, and the word offset of each and of the end."""
    sizes = np.diff(bounds)
    room = sizes if wide else (sizes + 1) // 2
    at = np.concatenate([[0], np.cumsum(HEAD + META + room + 1)]).astype(np.int64)
    words = np.zeros(int(at[-1]), "<u4")
    first, last = at[:-1], at[1:] - 1
    words[first], words[first + 1] = _halves((room + META) * 4)
    heads = np.stack([words[first], words[first + 1]], axis=1).ravel()
    words[first + 2] = masked(crc32c(heads, np.arange(0, len(heads) + 1, 2)))
    words[first + 3] = known + 2 * wide
    words[first + 4], words[first + 5] = _halves(doc_ids.astype(np.int64).view(np.uint64))
    words[first + 6] = sizes
    place = ragged((first + HEAD + META) * (1 if wide else 2), sizes)
    words.view("<u4" if wide else "<u2")[place] = ids
    body = _without(len(words), first, HEAD, last)
    words[last] = masked(crc32c(words[body], np.concatenate([[0], np.cumsum(room + META)])))
    return words, at


def parse_records(words: np.ndarray, offsets: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, all token ids (32 bit) and row bounds; raises if a checksum does not hold.

    The records must be of one width, as those of one file are.
    """
    first, last = offsets[:-1], offsets[1:] - 1
    payload = np.diff(offsets) - HEAD - 1
    heads = np.stack([words[first], words[first + 1]], axis=1).ravel()
    body = _without(len(words), first, HEAD, last)
    good = words[first + 2] == masked(crc32c(heads, np.arange(0, len(heads) + 1, 2)))
    good &= words[first].astype(np.int64) + (words[first + 1].astype(np.int64) << 32) == payload * 4
    good &= words[last] == masked(crc32c(words[body], np.concatenate([[0], np.cumsum(payload)])))
    if not good.all():
        raise ValueError(f"{int((~good).sum())} records are damaged")
    number = (words[first + 4].astype(np.uint64) | (words[first + 5].astype(np.uint64) << np.uint64(32))).view(np.int64)
    doc_ids = [int(n) if flag & 1 else None for n, flag in zip(number, words[first + 3], strict=True)]
    wide = bool(len(first) and words[first[0] + 3] & 2)
    sizes = words[first + 6].astype(np.int64)
    ids = words.view("<u4" if wide else "<u2")[ragged((first + HEAD + META) * (1 if wide else 2), sizes)]
    return doc_ids, ids.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def write_records(docs: DataFrame, root: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text's ids in ascending id order and returns the manifest.

    Files are numbered in that order; null ids come first, rows of one id are
    ordered by text. A null text has only the end id. Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.rec"
        out, index, at, tokens = None, [np.zeros((1, 2), np.int64)], 0, 0
        wide = max(end_id, encoder(tokenizer).tokenizer.get_vocab_size() - 1) > 0xFFFF
        for batch in sub_batches(batches, 1):
            out = out or create(path)
            ids, bounds = encode_with_end(batch.column(1), tokenizer, end_id)
            numbers = batch.column(0)
            words, where = frame_records(ids, bounds, numbers.fill_null(0).to_numpy(zero_copy_only=False), numbers.is_valid().to_numpy(zero_copy_only=False), wide)
            out.write(words)
            index.append(np.stack([at + where[1:] * 4, tokens + bounds[1:]], axis=1))
            at, tokens = at + len(words) * 4, tokens + len(ids)
        if out is None:
            return
        out.close()
        with create(path + ".idx") as file:
            file.write(np.concatenate(index).astype("<u8"))
        row = [[part], [path], [path + ".idx"], [sum(map(len, index)) - 1], [tokens], [at]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "path", "index_path", "records", "tokens", "bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return materialise(ordered.mapInArrow(write, MANIFEST), "records-manifest")


def read_records(spark: SparkSession, manifest: DataFrame, records_per_read: int = RECORDS_PER_READ) -> DataFrame:
    """One row per record from the files: id, ids before it in all files, size, CRC.

    Every task takes ranges of records, finds them through the index and checks
    both checksums of each.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with RangeReader(row["index_path"]) as file:
                    index = np.frombuffer(file.at(row["first"] * 16, (row["count"] + 1) * 16), "<u8").astype(np.int64).reshape(-1, 2)
                at, before = index[:, 0], index[:-1, 1]
                with RangeReader(row["path"]) as file:
                    words = np.frombuffer(file.at(int(at[0]), int(at[-1] - at[0])), "<u4")
                doc_ids, ids, bounds = parse_records(words, (at - at[0]) // 4)
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                crcs = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(row["base"] + before, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64()), pa.array([row["path"]] * row["count"]), pa.array(at[:-1], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "path", "byte_offset"])

    # The manifest has one row per file, so a window over all of it stays small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    reads = based.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(records_per_read).cast("long"))))
    reads = reads.select("path", "index_path", "base", "first", F.least(F.lit(records_per_read).cast("long"), F.col("records") - F.col("first")).alias("count"))
    pieces = manifest.agg(F.sum(F.ceil(F.col("records") / records_per_read))).first()[0] or 1
    return reads.repartition(int(min(pieces, 20_000)), "path", "first").mapInArrow(read, FOUND)


def token_records(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the ids of every text to record files and reads them all back."""
    spark = docs.sparkSession
    manifest = write_records(docs, scratch_path(spark, "records"), tokenizer)
    return read_records(spark, manifest)
