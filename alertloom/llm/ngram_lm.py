"""Language-model scores by a weighted backoff automaton.

The model interpolates n-grams with Dirichlet smoothing: with c the count of an n-gram
in the training texts, h its first words and w its last,

    p(w | h) = (c(hw) + MU * p(w | h without its first word)) / (c(h) + MU),

down to the smoothed unigrams, which sum to one over the known words and one unknown.
The n-grams that were seen are the arcs of an automaton, their beginnings its states.
Where a state has no arc for a word, its failure arc leads to the state without the
first word, at the weight MU / (c(h) + MU). A text is read once from left to right, the
state is carried, and the weights of all arcs taken add up to its log-probability.

The model is never held whole. Texts are dealt into blocks of bounded size. A block
asks for the distinct n-grams of its texts and brings its own counts along, in chunks
by ranges of their 64-bit hashes. A task per range adds up the counts of all blocks and
answers each in the order that it asked in. So what is frequent costs one entry a block,
no range is hot, and all counts cover all training texts. With its answers a block
builds the part of the automaton that its own texts can reach, and reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.bytetext import lower_ascii, mix64, row_slices, span_hashes, sub_batches, text_bytes, word_spans

ORDER = 3
MU = (20.0, 5.0)  # by order, from bigrams on; the last holds for all further ones
BLOCK_BYTES = 8 << 20  # of texts that are scored together
RANGE_BYTES = 8 << 20  # of text for each range of hashes
SEGMENT = 4_096  # tokens of a text that are read in one go
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text

SCORES = "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Smoothing:
    order: int = ORDER
    mu: tuple[float, ...] = MU
    add: float = 0.1  # to the count of every word, known or not

    def weight(self, n: int) -> float:
        """MU of n-grams."""
        return self.mu[min(n - 2, len(self.mu) - 1)]


class Tokens:
    """The tokens of a block's texts, and the distinct n-grams of each order.

    first: the first token of each text; kinds[n - 1]: sorted hashes of the n-grams,
    places[n - 1]: the number of the n-gram that ends at each token, -1 where the text
    is too short for one yet; shown[n - 1]: a token where each n-gram ends.
    """

    def __init__(self, texts: pa.Array, order: int):
        words, sizes = [], []
        data, bounds = text_bytes(texts)
        for a, b in row_slices(bounds):
            edges = bounds[a : b + 1] - bounds[a]
            part = lower_ascii(data[bounds[a] : bounds[b]])
            begin, end, before = word_spans(part, edges)
            words.append(span_hashes(part, begin, end))
            sizes.append(np.diff(before))
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(sizes) else sizes
        self.sizes = sizes + 1
        total = int(self.sizes.sum())
        hashes, last = np.empty(total, np.uint64), np.zeros(total, bool)
        last[self.first + sizes] = True
        hashes[~last], hashes[last] = (np.concatenate(words) if words else np.zeros(0, np.uint64)), END
        inside = np.arange(total) - np.repeat(self.first, self.sizes)
        self.kinds, self.places, self.shown = [], [], []
        rolled = np.zeros(total, np.uint64)
        for n in range(1, order + 1):
            if n > 1:
                rolled[1:] = rolled[:-1].copy()
            rolled = rolled * np.uint64(0x9FB21C651E98DF25) + hashes if n > 1 else hashes.copy()
            ends = np.flatnonzero(inside >= n - 1)
            kinds, shown, place = np.unique(mix64(rolled[ends] + np.uint64(n)), return_index=True, return_inverse=True)
            at = np.full(total, -1, np.int32)
            at[ends] = place
            self.kinds.append(kinds)
            self.places.append(at)
            self.shown.append(ends[shown])

    def counts(self, n: int, learned: np.ndarray) -> np.ndarray:
        """Occurrences of each n-gram in the texts marked as learned from."""
        place = self.places[n - 1]
        use = np.repeat(learned, self.sizes) & (place >= 0)
        return np.bincount(place[use], minlength=len(self.kinds[n - 1]))


class Automaton:
    """The part of the backoff automaton that the texts of a block reach.

    States and arcs are numbered by order as the n-grams of `tokens` are: state k of
    order n is the n-gram k read last, arc k of order n reads the last word of n-gram k
    from the state of its other words. An n-gram without a count has neither. counts
    holds the counts over all training texts, total and known their tokens and words.
    """

    def __init__(self, tokens: Tokens, counts: list[np.ndarray], total: int, known: int, smoothing: Smoothing):
        self.tokens, self.smoothing = tokens, smoothing
        share = (counts[0] + smoothing.add) / (total + smoothing.add * (known + 1))
        self.base = np.log10(share)
        self.unknown = float(np.log10(smoothing.add / (total + smoothing.add * (known + 1))))
        self.seen = [c > 0 for c in counts]
        self.arcs, self.failures = [self.base], []
        for n in range(2, smoothing.order + 1):
            mu, shown = smoothing.weight(n), tokens.shown[n - 1]
            lower = share[tokens.places[n - 2][shown]]
            above = counts[n - 2][tokens.places[n - 2][shown - 1]]
            share = (counts[n - 1] + mu * lower) / (above + mu)
            self.arcs.append(np.log10(share))
            self.failures.append(np.log10(mu / (counts[n - 2] + mu)))

    def read(self, begin: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Log-probabilities of the tokens start .. stop of a text each, read side by side.

        Reading begins in the root state at `begin`, so that the state is known at `start`.
        """
        order, places = self.smoothing.order, self.tokens.places
        by_length = np.argsort(begin - stop, kind="stable")
        begin, start, length = begin[by_length], start[by_length], (stop - begin)[by_length]
        depth, total = np.zeros(len(begin), np.int64), np.zeros(len(begin))  # depth: words of the state
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -k))
            at, here = begin[:live] + k, depth[:live]
            gained, after = np.zeros(live), np.zeros(live, np.int64)
            for n in range(order, 0, -1):
                rows = np.flatnonzero(here == n - 1)
                arc = places[n - 1][at[rows]]
                found = self.seen[n - 1][arc]
                if n == 1:
                    gained[rows] += np.where(found, self.arcs[0][arc], self.unknown)
                    after[rows] = np.where(found, min(1, order - 1), 0)
                    continue
                taken, failed = rows[found], rows[~found]
                gained[taken] += self.arcs[n - 1][arc[found]]
                after[taken], here[taken] = min(n, order - 1), -1
                gained[failed] += self.failures[n - 2][places[n - 2][at[failed] - 1]]
                here[failed] = n - 2
            depth[:live] = after
            total[:live] += np.where(at >= start[:live], gained, 0.0)
        out = np.empty(len(total))
        out[by_length] = total
        return out

    def scores(self) -> np.ndarray:
        """Log-probability of each text; long ones are read in several segments."""
        first, sizes, before = self.tokens.first, self.tokens.sizes, self.smoothing.order - 1
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first[owner] + number * SEGMENT
        stop = np.minimum(start + SEGMENT, (first + sizes)[owner])
        return np.bincount(owner, self.read(np.where(number > 0, start - before, start), start, stop), len(sizes))


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, by byte of equal worth, compressed."""
    flat = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(flat[:, :width].T).tobytes())


def unsqueeze(packed: bytes) -> np.ndarray:
    width = packed[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows (doc_id, learned, text) of a task in blocks of about BLOCK_BYTES, each with a
    number that its contents and its place decide."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def close() -> tuple[int, pa.Table]:
        block = pa.Table.from_batches(held).combine_chunks()
        sign = hashlib.blake2b(f"{part} {number}".encode(), digest_size=8)
        data, bounds = text_bytes(block.column(2))
        for x in (data, bounds, block.column(0).fill_null(-1).to_numpy(), block.column(1).to_numpy()):
            sign.update(np.ascontiguousarray(x).tobytes())
        return int.from_bytes(sign.digest(), "big", signed=True), block

    for batch in sub_batches(batches, 2):
        _, bounds = text_bytes(batch.column(2))
        held.append(batch)
        size += int(bounds[-1])
        if size >= BLOCK_BYTES:
            whole = close()
            number, held, size = number + 1, [], 0
            yield whole
            del whole
    if held:
        yield close()


def _range_edges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` equal parts of the hash space begins among sorted keys, and their number."""
    begin = np.array([-(-(r << 32) // ranges) for r in range(ranges)], np.uint64)
    return np.append(np.searchsorted(keys >> np.uint64(32), begin), len(keys))


def score_texts(docs: DataFrame, learned: Column, smoothing: Smoothing | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    learned: a condition on docs; the model learns from the rows where it is true (null:
    not). Tokens are the words between ASCII white space, A-Z in lower case, and one end.
    A null text is empty: its end alone. n_known counts tokens that occur in what was
    learned; base_score is by unigrams alone; both scores are log10 probabilities. Null
    and repeated ids and repeated rows are scored and learned from each; other columns
    are not read. Where nothing is learned, all words are unknown. Very long texts are
    read in segments. docs is read twice and must give the same partitions each time, as
    tables do; if it does not, the query fails.
    """
    smoothing = smoothing or Smoothing()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learned, F.lit(False)).alias("learned"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    order = smoothing.order

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_table(block)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "texts"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches):
            tokens, own = Tokens(block.column(2), order), block.column(1).to_numpy()
            for n in range(1, order + 1):
                keys, counts = tokens.kinds[n - 1], tokens.counts(n, own)
                edges = _range_edges(keys, ranges)
                # Every range tells every block its share of all tokens and words.
                asked = [r for r in range(ranges) if n == 1 or edges[r] < edges[r + 1]]
                parts = [slice(edges[r], edges[r + 1]) for r in asked]
                steps = [squeeze(np.diff(keys[p], prepend=np.uint64(0))) for p in parts]
                size = len(asked)
                yield pa.RecordBatch.from_arrays([pa.array([number] * size, pa.int64()), pa.array([n] * size, pa.int32()), pa.array(asked, pa.int64()), pa.array(steps, pa.binary()), pa.array([squeeze(counts[p]) for p in parts], pa.binary())], ["block", "n", "range", "keys", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        asked = [np.cumsum(unsqueeze(x), dtype=np.uint64) for x in group.column("keys").to_pylist()]
        counts = np.concatenate([unsqueeze(x) for x in group.column("counts").to_pylist()]).astype(np.int64)
        found, place = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, place, counts)
        edges = np.cumsum([0, *map(len, asked)])
        size, alone = len(asked), group.column("n")[0].as_py() == 1
        total, known = (int(sums.sum()), int((sums > 0).sum())) if alone else (0, 0)
        replies = [squeeze(sums[place[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"block": group.column("block"), "n": group.column("n"), "range": group.column("range"), "counts": pa.array(replies, pa.binary()), "total": pa.array([total] * size, pa.int64()), "known": pa.array([known] * size, pa.int64())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            raise RuntimeError("the texts changed between two readings")
        block = pa.ipc.open_stream(left.column("texts")[0].as_py()).read_all()
        tokens = Tokens(block.column("text"), order)
        right = right.sort_by([("n", "ascending"), ("range", "ascending")])
        which, replies = right.column("n").to_numpy(), right.column("counts").to_pylist()
        counts = [np.concatenate([unsqueeze(replies[k]) for k in np.flatnonzero(which == n)] or [np.zeros(0, np.uint64)]).astype(np.int64) for n in range(1, order + 1)]
        if [len(c) for c in counts] != [len(k) for k in tokens.kinds]:
            raise RuntimeError("the texts changed between two readings")
        total, known = (int(right.column(name).to_numpy().sum()) for name in ("total", "known"))
        automaton = Automaton(tokens, counts, total, known, smoothing)
        single = tokens.places[0]
        sums = lambda x: np.add.reduceat(x, tokens.first)
        size = block.num_rows
        return pa.table({
            "doc_id": block.column("doc_id"), "learned": block.column("learned"), "n_tokens": pa.array(tokens.sizes.astype(np.int64)),
            "n_known": pa.array(sums(automaton.seen[0][single].astype(np.int64))), "train_tokens": pa.array([total] * size, pa.int64()),
            "base_score": pa.array(sums(automaton.base[single])), "score": pa.array(automaton.scores()),
        })

    asked = rows.mapInArrow(ask, "block long, n int, range long, keys binary, counts binary")
    answers = asked.groupBy("n", "range").applyInArrow(answer, "block long, n int, range long, counts binary, total long, known long")
    packed = rows.mapInArrow(pack, "block long, texts binary")
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
