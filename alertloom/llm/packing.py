"""Vector bin packing of token sequences.

A sequence has three limits: tokens, segments (pieces of documents) and
loss-bearing tokens. Documents longer than a sequence give whole sequences first;
what is left of each is placed by the dot-product heuristic: of the pieces that
fit, the one whose demand points most along the room left (both in shares of the
limits, weighted by mean demand) goes in next. Where nothing fits whole, the
longest piece is cut to fill the gap. A sequence that must end before it is full
is cut back to a power of two, at which no padding is needed; the rest goes on.

Each task packs its own rows in blocks of bounded size, so nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.bytetext import sub_batches
from alertloom.llm.wordbpe import END_ID, encode_with_end

BLOCK_PIECES = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2047


@dataclass
class Piece:
    """Tokens [start, end) of a document; the first `prompt` tokens of it bear no loss."""

    doc: int
    start: int
    end: int
    prompt: int = 0

    @property
    def size(self) -> int:
        return self.end - self.start

    @property
    def loss(self) -> int:
        """The first token of a segment has nothing to be predicted from."""
        return max(0, self.end - max(self.start + 1, self.prompt))

    def within(self, tokens: int, loss: int) -> int:
        """The longest front of this piece within so many tokens and loss-bearing tokens."""
        return max(0, min(self.end, self.start + tokens, max(self.start + 1, self.prompt) + loss) - self.start)

    def cut(self, size: int) -> tuple[Piece, Piece]:
        middle = self.start + size
        return Piece(self.doc, self.start, middle, self.prompt), Piece(self.doc, middle, self.end, self.prompt)


@dataclass
class Packer:
    """Packs the pieces of one task; `done` gets finished sequences."""

    limits: Limits
    done: list[list[Piece]] = field(default_factory=list)
    open: list[Piece] = field(default_factory=list)

    def add(self, pieces: list[Piece]) -> None:
        """Places all the pieces; the last sequence stays open."""
        most = self.limits
        rest = list(pieces)
        tokens = np.array([p.size for p in rest], np.int64)
        loss = np.array([p.loss for p in rest], np.int64)
        live = len(rest)
        weight = np.array([tokens.mean() / most.tokens, loss.mean() / max(1, most.loss_tokens)]) if live else None
        while live:
            room = most.tokens - sum(p.size for p in self.open)
            room_loss = most.loss_tokens - sum(p.loss for p in self.open)
            if not room or len(self.open) >= most.segments:
                rest, tokens, loss, live = self._return(self.close(), rest, tokens, loss, live)
                continue
            fits = (tokens <= room) & (loss <= room_loss)
            if fits.any():
                # The segment term is the same for every piece, so it never decides.
                gain = tokens * (weight[0] * room / most.tokens**2) + loss * (weight[1] * room_loss / max(1, most.loss_tokens) ** 2)
                which = int(np.argmax(np.where(fits, gain, -1.0)))
                self.open.append(rest[which])
                rest[which] = rest[-1]
                tokens[which], loss[which] = tokens[-1], loss[-1]
                rest.pop()
                tokens, loss, live = tokens[:-1], loss[:-1], live - 1
                continue
            which = int(np.argmax(tokens))
            size = rest[which].within(room, room_loss)
            if not size:
                rest, tokens, loss, live = self._return(self.close(), rest, tokens, loss, live)
                continue
            front, back = rest[which].cut(size)
            self.open.append(front)
            rest[which], tokens[which], loss[which] = back, back.size, back.loss

    @staticmethod
    def _return(back: list[Piece], rest: list[Piece], tokens: np.ndarray, loss: np.ndarray, live: int) -> tuple[list[Piece], np.ndarray, np.ndarray, int]:
        if not back:
            return rest, tokens, loss, live
        rest.extend(back)
        return rest, np.append(tokens, [p.size for p in back]), np.append(loss, [p.loss for p in back]), live + len(back)

    def close(self) -> list[Piece]:
        """Ends the open sequence at its limit or at a power of two; returns the rest."""
        total = sum(p.size for p in self.open)
        keep = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
        kept: list[Piece] = []
        back: list[Piece] = []
        for piece in self.open:
            if keep >= piece.size:
                kept.append(piece)
                keep -= piece.size
            elif keep:
                front, rest = piece.cut(keep)
                kept.append(front)
                back.append(rest)
                keep = 0
            else:
                back.append(piece)
        self.done.append(kept)
        self.open = []
        return back

    def finish(self) -> None:
        while self.open:
            self.open = self.close()


def split_document(doc: int, size: int, prompt: int, limits: Limits) -> tuple[list[Piece], list[Piece]]:
    """Pieces that fill a sequence alone, and the others."""
    whole, others, start = [], [], 0
    while start < size:
        piece = Piece(doc, start, size, prompt)
        taken, _ = piece.cut(piece.within(limits.tokens, limits.loss_tokens))
        (whole if taken.size == limits.tokens else others).append(taken)
        start = taken.end
    return whole, others


def pack_texts(docs: DataFrame, tokenizer: str, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Packs every text; one row per piece.

    Each row of docs is packed for itself, repeated rows and null ids too; a null
    text is the end id alone. prompt_col counts leading tokens without loss (null:
    none). Other columns are not read. sequence_id is the task's number above bit
    33 and a counter below.
    """
    limits = limits or Limits()
    if limits.tokens < 1 or limits.segments < 1 or limits.loss_tokens < 1:
        raise ValueError("limits must be positive")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits), TaskContext.get().partitionId() << 33
        kept: dict[int, tuple[int | None, int, int, memoryview]] = {}  # id, ids before the tail, all ids, the tail's ids
        count = sequence = 0

        def rows(sequences: list[list[Piece]], out: list[tuple]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    doc_id, skipped, total, raw = kept[p.doc]
                    crc = zlib.crc32(raw[(p.start - skipped) * 4 : (p.end - skipped) * 4])
                    out.append((doc_id, p.start, p.size, crc, total, base + sequence, offset, p.loss))
                    offset += p.size
                sequence += 1

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in zip(*out, strict=True)], names)

        waiting: list[Piece] = []
        for batch in sub_batches(batches, 1):
            out: list[tuple] = []
            doc_ids, prompts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            ids, bounds = encode_with_end(batch.column(1), tokenizer, end_id)
            raw = memoryview(ids).cast("B")
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                whole, others = split_document(count, b - a, prompts[k], limits)
                kept[count] = (doc_ids[k], 0, b - a, raw[a * 4 : b * 4])
                rows([[p] for p in whole], out)
                if others:
                    first = others[0].start
                    kept[count] = (doc_ids[k], first, b - a, memoryview(bytes(raw[(a + first) * 4 : b * 4])))
                    waiting += others
                else:
                    del kept[count]
                count += 1
                if len(waiting) >= BLOCK_PIECES:
                    packer.add(waiting)
                    rows(packer.done, out)
                    packer.done, waiting = [], []
                    needed = {p.doc for p in packer.open}
                    kept = {d: v for d, v in kept.items() if d in needed}
            if out:
                yield batch_of(out)
        packer.add(waiting)
        packer.finish()
        out = []
        rows(packer.done, out)
        if out:
            yield batch_of(out)

    prompt = F.lit(0) if prompt_col is None else F.greatest(F.coalesce(F.col(prompt_col), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), prompt.cast("int").alias("prompt"))
    return rows.mapInArrow(pack, PIECES)
