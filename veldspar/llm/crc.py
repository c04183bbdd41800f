"""CRC-32 of words, and of strings put together from them, by algebra over GF(2).

The CRC of a string a followed by b is shift(crc(a), len(b)) XOR crc(b), where shift by one byte is a linear map of 32
bits, thus a matrix over GF(2), and shift by n bytes its n-th power.  Powers of two are kept as tables of the map on each of
the four bytes, and a shift by n is one table look-up per set bit of n, for arrays of values side by side.
"""

from __future__ import annotations

import zlib

import numpy as np

#: The reflected generator polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words longer than this are handed to zlib one by one; shorter ones go side by side, a byte at a time.
LONG = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _square(matrix: np.ndarray) -> np.ndarray:
    """The map applied twice; column i of a matrix is the image of bit i."""
    return apply(spread(matrix), matrix)


def spread(matrix: np.ndarray) -> np.ndarray:
    """Tables (4 x 256) of a map's values on each byte of its argument, from its 32 columns."""
    out = np.zeros((4, 256), np.uint32)
    value = np.arange(256)
    for bit in range(32):
        out[bit // 8] ^= np.where(value >> (bit % 8) & 1, matrix[bit], 0).astype(np.uint32)
    return out


def apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


BYTE = _byte_table()


def _powers(n: int) -> list[np.ndarray]:
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    matrix = BYTE[unit & 255] ^ (unit >> 8)  # one zero byte
    out = []
    for _ in range(n):
        out.append(spread(matrix))
        matrix = _square(matrix)
    return out


#: Shifts by 1, 2, 4, ... bytes; texts are under 2**31 bytes.
SHIFTS = _powers(32)


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that crc has in the CRC of a string that goes on for n more bytes."""
    out = crc.copy()
    for bit in range(int(n.max(initial=0)).bit_length()):
        some = np.flatnonzero(n >> bit & 1)
        out[some] = apply(SHIFTS[bit], out[some])
    return out


def join(a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """CRC of strings put together, from those of their halves and the second's size in bytes."""
    return shift(a, size_b) ^ b


def words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC of every word, each byte read once."""
    size = end - start
    out = np.empty(len(size), np.uint32)
    long = np.flatnonzero(size > LONG)
    for i in long.tolist():
        out[i] = zlib.crc32(buf[start[i] : end[i]])
    order = np.argsort(-size, kind="stable")[len(long) :]
    at, n = start[order], size[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -k, side="left"))  # words of more than k bytes stand first
        own = state[:live]
        state[:live] = BYTE[(own ^ buf[at[:live] + k]) & 255] ^ (own >> 8)
    out[order] = ~state
    return out
