"""Vectorised text kernels: words and hashes over Arrow string buffers, no per-word Python.

A slice is a run of whole documents whose bytes lie in one buffer; slices hold about
SLICE_BYTES bytes (or one longer document), so working memory stays bounded whatever the
batch.  Where equal words must be told from words of equal hash, their bytes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64


def _lut(bytes_: list[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[bytes_] = True
    return out


#: Bytes between words: space and 09-0D.
SPACE = _lut([0x20, *range(0x09, 0x0E)])
#: Bytes between words of letters and digits: ASCII other than 0-9 a-z (texts are lower-cased first).
NOT_ALNUM = _lut([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def load8(buf: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number, those after the first `rest` as zero."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8")[:, 0]
    return x & MASKS[np.minimum(rest, 8)]


#: The low bytes that are kept of eight.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
STEP = U64(0x9E3779B97F4A7C15)


class Hasher:
    """64-bit hashes of words and of runs of words, which no pattern in the words makes equal.

    A word is cut into chunks of eight bytes.  Each is put through the mixer under a key of its place, and
    what comes out is summed with odd factors of the place and mixed with the length.  Runs are mixed pairwise, run of 2, 4, 8 ... words by
    the two halves, so no sum of powers stands over the whole run either.
    """

    def __init__(self, seed: int):
        self.seed = mix(np.array([seed + 1], U64) * STEP)
        self.keys, self.factors = np.zeros(0, U64), np.zeros(0, U64)

    def _places(self, n: int) -> None:
        if len(self.keys) < n:
            at = np.arange(max(n, 2 * len(self.keys)), dtype=U64)
            self.keys = mix(at * STEP + self.seed)
            self.factors = mix(self.keys + U64(1)) | U64(1)

    def words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each of the words, none of which is empty."""
        size = end - start
        if not len(size):
            return np.zeros(0, U64)
        chunks = (size + 7) >> 3
        off = np.concatenate([[0], np.cumsum(chunks)])
        k = np.arange(off[-1]) - np.repeat(off[:-1], chunks)
        self._places(int(chunks.max()))
        x = load8(buf, np.repeat(start, chunks) + 8 * k, np.repeat(size, chunks) - 8 * k)
        x = mix(x ^ self.keys[k]) * self.factors[k]
        return mix(np.add.reduceat(x, off[:-1]) ^ (size.astype(U64) * STEP + self.seed))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * STEP + (b ^ self.seed))

    def grams(self, hashes: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k consecutive word hashes from each start."""
        if not len(start):
            return np.zeros(0, U64)
        run, width, done, out = hashes, 1, 0, None
        while True:
            if k & width:
                part = run[start + done]
                out = part if out is None else self._pair(out, part)
                done += width
            if 2 * width > k:
                return mix(out ^ (np.array([k], U64) * STEP))
            run = self._pair(run[:-width], run[width:])
            width *= 2


def same_bytes(a: np.ndarray, at: np.ndarray, size: np.ndarray, b: np.ndarray, there: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the words at `at` in a and at `there` in b, of the sizes `size` and `other`, are the same bytes."""
    same = size == other
    left = np.flatnonzero(same)
    for k in range(0, 64, 8):  # words over 64 bytes are compared further below
        left = left[size[left] > k]
        if not len(left):
            return same
        rest = size[left] - k
        equal = load8(a, at[left] + k, rest) == load8(b, there[left] + k, rest)
        same[left[~equal]] = False
        left = left[equal]
    for i in left[size[left] > 64].tolist():
        same[i] = bool((a[at[i] : at[i] + size[i]] == b[there[i] : there[i] + size[i]]).all())
    return same


def exact_groups(hashes: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, place): one word of each group of equal words, in order of hash, and the group of every word.

    Words of one hash whose bytes differ make groups of their own.
    """
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_bytes(buf, start, size, buf, start[first[place]], size[first[place]]))
    if not len(odd):
        return first, place
    by_text: dict[tuple[int, bytes], int] = {}
    key = first[place]
    for i in odd.tolist():
        key[i] = by_text.setdefault((int(hashes[i]), buf[start[i] : start[i] + size[i]].tobytes()), i)
    found, place = np.unique(key, return_inverse=True)
    order = np.lexsort((found, hashes[found]))
    back = np.empty(len(found), np.int64)
    back[order] = np.arange(len(found))
    return found[order], back[place]


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; a null takes no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of documents of about `most` bytes."""
    buf, off = string_buffer(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n, i + 65536)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def find_words(buf: np.ndarray, off: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and n + 1 word offsets of the documents."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = between[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[off[:-1][off[:-1] < n]] = True
    after[-1], after[:-1] = True, gap[1:]
    after[off[1:][off[1:] > 0] - 1] = True
    solid = ~gap
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(start, off)


def gram_starts(word_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index at which each k-gram inside one document starts, and n + 1 gram offsets of the documents."""
    per = np.maximum(np.diff(word_off) - k + 1, 0)
    off = np.concatenate([[0], np.cumsum(per)])
    return np.arange(off[-1]) + np.repeat(word_off[:-1] - off[:-1], per), off


def take_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes start[i] .. start[i] + length[i] - 1 of all i, one after another."""
    off = np.concatenate([[0], np.cumsum(length)])
    return np.arange(off[-1]) + np.repeat(start - off[:-1], length)


def cover(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in some range."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0
