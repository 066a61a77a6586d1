"""CRC-32C (Castagnoli) of many byte spans at once, by its linearity, and the masking of record files."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 64
POLYNOMIAL = 0x82F63B78  # fixed by the checksum
MASK_DELTA = 0xA282EAD8  # fixed by the record format


@lru_cache(1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


@lru_cache(1)
def _place_tables() -> np.ndarray:
    """[i][b]: what byte b contributes when i more bytes of its block follow."""
    t = _byte_table()
    out = [t]
    for _ in range(BLOCK - 1):
        out.append(t[out[-1] & 0xFF] ^ (out[-1] >> 8))
    return np.stack(out)


@lru_cache(1)
def _shift_tables() -> np.ndarray:
    """[i][b]: a register with byte i equal to b, moved on over a block of zeros."""
    t, out = _byte_table(), []
    for i in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
        for _ in range(BLOCK):
            x = t[x & 0xFF] ^ (x >> 8)
        out.append(x)
    return np.stack(out)


def crc32c(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Checksum of each span at[i]:at[i + 1] of the bytes.

    A span is padded in front to whole blocks (leading zeros leave an empty register as it is); the usual
    start value is folded into its first four bytes, or into the register for shorter spans.
    """
    n = at[1:] - at[:-1]
    out = np.zeros(len(n), np.uint32)
    short = n < 4
    for i in np.flatnonzero(short):
        x, t = np.uint32(0xFFFFFFFF), _byte_table()
        for b in data[at[i]:at[i + 1]].tolist():
            x = t[(int(x) ^ b) & 0xFF] ^ (x >> np.uint32(8))
        out[i] = x
    long = np.flatnonzero(~short)
    if len(long):
        blocks = -(-n[long] // BLOCK)
        first = np.concatenate(([0], np.cumsum(blocks)))
        padded = np.zeros(first[-1] * BLOCK, np.uint8)
        to = first[1:] * BLOCK - n[long]
        move = np.repeat(to - at[:-1][long], n[long]) + _runs(at[:-1][long], n[long])
        padded[move] = data[_runs(at[:-1][long], n[long])]
        for j in range(4):
            padded[to + j] ^= 0xFF
        places, part = _place_tables(), np.zeros(first[-1], np.uint32)
        padded = padded.reshape(-1, BLOCK)
        for j in range(BLOCK):
            part ^= places[BLOCK - 1 - j][padded[:, j]]
        shift, register, left = _shift_tables(), np.zeros(len(long), np.uint32), np.argsort(-blocks, kind="stable")
        for k in range(int(blocks.max())):
            left = left[:int(np.searchsorted(-blocks[left], -k, side="left"))]
            r = register[left]
            moved = shift[0][r & 0xFF] ^ shift[1][(r >> 8) & 0xFF] ^ shift[2][(r >> 16) & 0xFF] ^ shift[3][r >> 24]
            register[left] = moved ^ part[first[left] + k]
        out[long] = register
    return out ^ np.uint32(0xFFFFFFFF)


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0] + n[0] - 1, begin[1] .. and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
