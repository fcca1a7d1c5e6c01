"""Token ids of whole texts, with one call of the tokenizers library per new word.

The tokenizer is a byte-level BPE over separate pieces (contractions, letter
runs, single digits, symbol runs) of lower-cased text, so the ids of a text are
those of its pieces in turn. Texts of ASCII and Latin-1 characters are cut into
pieces with array operations; each distinct piece is encoded once by the library
and remembered. Every other text (other scripts, controls, special tokens) goes
to the library whole. Both ways give the same ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from alertloom.llm.bytetext import SLICE_BYTES, mix64, ragged, row_slices, span_hashes, text_bytes

END_ID = 1
MEMORY = 1 << 19  # pieces remembered by one worker before it starts afresh

_SPACES, _LETTER, _NUMBER, _OTHER, _ODD = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each Latin-1 character and its lower-case form; _ODD: not handled here."""
    kind = np.full(256, _ODD, np.uint8)
    kind[[0x09, 0x0A, 0x0D, 0x20]] = _SPACES
    for code in (*range(0x21, 0x7F), *range(0xA1, 0x100)):
        if code == 0xAD:  # soft hyphen: left to the library
            continue
        char = chr(code)
        kind[code] = _LETTER if char.isalpha() else _NUMBER if char.isnumeric() else _OTHER
    lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256)])
    return kind, lower.astype(np.uint8)


_KIND, _LOWER = _classes()


def _byte_chars() -> dict[int, str]:
    """The character that byte-level vocabularies show each byte as: itself if it
    prints, else the next free one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + k) for k, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()


class PieceEncoder:
    """Encodes batches of texts with one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [step["type"] for step in spec["pre_tokenizer"].get("pretokenizers", [])] if spec.get("pre_tokenizer") else []
        # Only this make-up of a tokenizer is known to work piece by piece.
        self.by_piece = kinds == ["Split", "ByteLevel"] and spec.get("post_processor") is None
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.size = 1 << 16
        self.key = np.zeros(self.size, np.uint64)
        self.at = np.full(self.size, -1, np.int32)
        self.start = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int32)
        self.hashes = np.zeros(0, np.uint64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and the number of ids of each text."""
        data, bounds = text_bytes(column)
        ids, counts = [], []
        for rows in row_slices(bounds):
            part_ids, part_counts = self._rows(data, bounds[rows[0] : rows[1] + 1])
            ids.append(part_ids)
            counts.append(part_counts)
        none = np.zeros(0, np.uint32)
        return (np.concatenate(ids) if ids else none), (np.concatenate(counts) if counts else np.zeros(0, np.int64))

    def _rows(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(bounds) == 2 and bounds[1] - bounds[0] > SLICE_BYTES:
            parts = list(self._long(data[bounds[0] : bounds[1]]))
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        part, edges = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        plain = self._plain(part, edges)
        if plain.all():
            return self._pieces(part, edges)
        # Whole texts for the library; the others keep their order among themselves.
        texts = [part[edges[i] : edges[i + 1]].tobytes().decode() for i in np.flatnonzero(~plain)]
        whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        kept = np.flatnonzero(plain)
        sizes = np.diff(edges)[kept]
        ids, counts = self._pieces(part[ragged(edges[kept], sizes)], np.concatenate([[0], np.cumsum(sizes)]))
        cuts = np.split(ids, np.cumsum(counts)[:-1]) if len(kept) else []
        rows: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(plain)
        for i, row in zip(kept, cuts, strict=True):
            rows[i] = row
        for i, row in zip(np.flatnonzero(~plain), whole, strict=True):
            rows[i] = row
        return np.concatenate(rows), np.array([len(r) for r in rows])

    def _long(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """One very long text, cut at spaces: no piece crosses a space."""
        if not self._plain(data, np.array([0, len(data)]))[0]:
            yield np.array(self.tokenizer.encode(data.tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            return
        start = 0
        while start < len(data):
            stop = min(start + SLICE_BYTES, len(data))
            while stop < len(data):
                spaces = np.flatnonzero(data[start:stop] == 0x20)
                if len(spaces):
                    stop = start + int(spaces[-1]) + 1
                    break
                stop = min(stop + SLICE_BYTES, len(data))
            yield self._pieces(data[start:stop], np.array([0, stop - start]))[0]
            start = stop

    def _plain(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts hold only characters that are cut into pieces here."""
        rows = len(bounds) - 1
        if not self.by_piece:
            return np.zeros(rows, bool)
        if not len(data):
            return np.ones(rows, bool)
        bad = (_KIND[data] == _ODD) & (data < 0x80) | (data >= 0xC4)
        lead = np.flatnonzero(data == 0xC2)
        bad[lead[_KIND[data[lead + 1]] == _ODD]] = True
        total = np.concatenate([[0], np.cumsum(bad)])
        plain = total[bounds[1:]] == total[bounds[:-1]]
        bars = np.flatnonzero(data == ord("|"))
        bars = bars[(bars > 0) & (data[bars - 1] == ord("<"))]
        for row in np.unique(np.searchsorted(bounds, bars, "right") - 1):
            text = data[bounds[row] : bounds[row + 1]].tobytes().decode()
            if any(s in text for s in self.specials):
                plain[row] = False
        return plain

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        low = _LOWER[data]
        kind = _KIND[data]
        high = data >= 0x80
        if high.any():
            low[high] = data[high]
            lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
            code = np.where(data[lead] == 0xC3, data[lead + 1] + 0x40, data[lead + 1]).astype(np.uint8)
            kind[lead] = kind[lead + 1] = _KIND[code]
            small = _LOWER[code]
            low[lead + 1] = np.where(small >= 0xC0, small - 0x40, small)
            low[lead] = np.where(small >= 0xC0, 0xC3, 0xC2)
            # U+00B5 and U+00FF have no other case within Latin-1
        tail = (data & 0xC0) == 0x80
        edge = np.zeros(n + 2, bool)
        edge[bounds] = True
        before = np.empty(n, np.uint8)
        before[0], before[1:] = _ODD, kind[:-1]
        start = (kind != _SPACES) & ~tail & ((kind != before) | (kind == _NUMBER) | edge[:n])
        quote = np.flatnonzero(start & (data == ord("'")))
        if len(quote):
            # A quote that begins a piece joins s, t, m, d, re, ve or ll.
            padded = np.concatenate([low, np.zeros(2, np.uint8)])
            one, two = padded[quote + 1], padded[quote + 2]
            inside = ~edge[quote + 1]
            short = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
            pair = inside & ~edge[quote + 2] & ((((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for which, k in ((short, 1), (pair, 2)):
                at = quote[which]
                start[at + 1] = False
                rest = at + 1 + k
                rest = rest[rest < n]
                start[rest] = start[rest] | ((kind[rest] == _LETTER) & ~edge[rest])
        begin = np.flatnonzero(start)
        stop = start.copy()
        stop |= kind == _SPACES
        stop |= edge[:n]
        stops = np.append(np.flatnonzero(stop), n)
        end = stops[np.searchsorted(stops, begin) + 1] if len(begin) else begin
        which = self._look_up(low, begin, end)
        sizes = self.length[which]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[ragged(self.start[which], sizes)]
        return ids, np.diff(sums[np.searchsorted(begin, bounds)])

    def _look_up(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each piece among the remembered ones; new pieces are encoded first."""
        hashes = span_hashes(low, begin, end)
        found = self._find(hashes)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            fresh, first = np.unique(hashes[lost], return_index=True)
            if len(self.hashes) + len(fresh) > MEMORY and len(self.hashes):
                self._forget()
                return self._look_up(low, begin, end)
            rows = [self._piece(low[b:e].tobytes()) for b, e in zip(begin[lost[first]], end[lost[first]], strict=True)]
            sizes = np.array([len(r) for r in rows], np.int32)
            self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)])
            self.length = np.concatenate([self.length, sizes])
            self.ids = np.concatenate([self.ids, np.fromiter((x for r in rows for x in r), np.uint32, int(sizes.sum()))])
            known = len(self.hashes)
            self.hashes = np.concatenate([self.hashes, fresh])
            if len(self.hashes) * 2 > self.size:
                while len(self.hashes) * 2 > self.size:
                    self.size *= 2
                self.key, self.at = np.zeros(self.size, np.uint64), np.full(self.size, -1, np.int32)
                known = 0
            self._insert(self.hashes[known:], np.arange(known, len(self.hashes), dtype=np.int32))
            found[lost] = self._find(hashes[lost])
        return found

    def _piece(self, piece: bytes) -> list[int]:
        """Ids of one lower-cased piece, by the library's model alone."""
        return [token.id for token in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(_BYTE_CHARS))]

    def _slots(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        return ((mix64(hashes) + np.uint64(probe)) & np.uint64(self.size - 1)).astype(np.int64)

    def _insert(self, hashes: np.ndarray, number: np.ndarray) -> None:
        probe = 0
        while len(hashes):
            slot = self._slots(hashes, probe)
            free = self.at[slot] < 0
            self.at[slot[free]] = number[free]  # of several for one slot the last stays
            placed = self.at[slot] == number
            self.key[slot[placed]] = hashes[placed]
            hashes, number, probe = hashes[~placed], number[~placed], probe + 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        left, probe = np.arange(len(hashes)), 0
        while len(left):
            slot = self._slots(hashes[left], probe)
            at = self.at[slot]
            hit = (at >= 0) & (self.key[slot] == hashes[left])
            out[left[hit]] = at[hit]
            left, probe = left[(at >= 0) & ~hit], probe + 1
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encode_with_end(column: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text followed by the end id: all ids in turn, and row bounds."""
    ids, counts = encoder(path).encode(column)
    bounds = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
    out = np.full(int(bounds[-1]), end_id, "<u4")
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds
