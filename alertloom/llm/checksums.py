"""CRC-32C of many records at once, over arrays of 32-bit little-endian words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_POLYNOMIAL = 0x82F63B78  # Castagnoli, bits reversed
_LANE = 64  # words that one lane takes step by step
_U8 = np.uint32(0xFF)


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), table >> np.uint32(1))
    return table


@lru_cache(maxsize=1)
def _word_tables() -> list[np.ndarray]:
    """Tables that move a register over one word: by its lowest byte first."""
    step = _byte_table()
    tables = [step]
    for _ in range(3):
        last = tables[-1]
        tables.append((last >> np.uint32(8)) ^ step[last & _U8])
    return tables[::-1]


def _apply(tables: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return tables[0][x & _U8] ^ tables[1][(x >> np.uint32(8)) & _U8] ^ tables[2][(x >> np.uint32(16)) & _U8] ^ tables[3][x >> np.uint32(24)]


@lru_cache(maxsize=64)
def _skip_tables(power: int) -> list[np.ndarray]:
    """Tables that move a register over 2**power zero words."""
    if not power:
        return _word_tables()
    half = _skip_tables(power - 1)
    return [_apply(half, table) for table in half]


def crc32c(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """CRC-32C of words[bounds[i]:bounds[i + 1]] for every i."""
    sizes = np.diff(bounds)
    rows = len(sizes)
    if not rows:
        return np.zeros(0, np.uint32)
    # Leading zeros do not change a register that starts at 0, so every record is
    # padded in front to whole lanes; the real starting value is added afterwards.
    lanes = -(-sizes // _LANE)
    lane_end = np.cumsum(lanes)
    padded = np.zeros(int(lane_end[-1]) * _LANE, np.uint32)
    where = np.repeat(lane_end * _LANE - sizes, sizes) + np.arange(len(words)) - np.repeat(bounds[:-1] - bounds[0], sizes)
    padded[where] = words
    grid = np.ascontiguousarray(padded.reshape(-1, _LANE).T)
    tables, state = _word_tables(), np.zeros(grid.shape[1], np.uint32)
    for row in grid:
        state = _apply(tables, state ^ row)
    total, skip = np.zeros(rows, np.uint32), _skip_tables(_LANE.bit_length() - 1)
    order = np.argsort(-lanes, kind="stable")
    first, ranked = (lane_end - lanes)[order], -lanes[order]
    for j in range(int(lanes.max())):
        live = order[: np.searchsorted(ranked, -j, "left")]
        total[live] = _apply(skip, total[live]) ^ state[first[: len(live)] + j]
    start = np.full(rows, 0xFFFFFFFF, np.uint32)
    for power in range(int(sizes.max()).bit_length()):
        odd = (sizes >> power) & 1 == 1
        start[odd] = _apply(_skip_tables(power), start[odd])
    return total ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The rotated and shifted form in which record files store a checksum."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
