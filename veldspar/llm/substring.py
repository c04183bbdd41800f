"""Substring deduplication with a count-min prefilter.

A window is WINDOW consecutive words of one document.  A word is removed if some window over it has a word
sequence that also starts earlier: in a document of smaller id, or earlier in the same one.

1. Every piece of documents (see pieces) sketches its windows: two rows of counters, kept sparse as sorted cells, one part per shard
   of the hash space.  A shard merges its parts of all pieces into the count-min rows, which never undercount, and tells each piece which of its cells
   stand at two or more.
2. Windows whose two cells are both repeated are estimated repeated; none that repeats is lost.  Only
   those are sent on, once per piece, with a 128-bit hash; shards group them exactly and say which piece has the first of each.
3. Pieces remove every later occurrence.

The sketch is as wide as COUNTERS_PER_WINDOW times the windows of its shard, so the share of windows that pass by accident stays near 5 % at every size.

Cases: words are [^space, 09-0D]+, unchanged; null texts have none; a document of fewer words than a window keeps all;
ids are integers, a null id stands before all others; of repeated rows with one id those in earlier pieces come first;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import materialise
from .pieces import MESSAGE, PER_SHARD, PIECE_BYTES, Piece, each_piece, merge, messages, pack, shard_of, unpack, with_answers, write_pieces

WINDOW = 20
COUNTERS_PER_WINDOW = 4
SEED = 11


class Windows:
    """Windows of a piece, their hashes and sketch cells."""

    def __init__(self, piece: Piece, window: int, shards: int, width: int):
        hashers = [kernel.Hasher(SEED), kernel.Hasher(SEED + 1)]
        (first, second), self.start, self.end, self.word_off = piece.words(hashers, lower=False)
        self.at, self.off = kernel.gram_starts(self.word_off, window)
        self.a = hashers[0].grams(first, self.at, window)
        self.b = hashers[1].grams(second, self.at, window)
        shard = shard_of(self.a, shards) << kernel.U64(32)
        self.cells = [shard | (self.b & kernel.U64(width - 1)), shard | ((self.b >> kernel.U64(32)) & kernel.U64(width - 1))]


def _sketch(windows: Windows, piece: int) -> Iterator[pa.RecordBatch]:
    rows = [np.unique(c, return_counts=True) for c in windows.cells]
    shards = np.unique(rows[0][0] >> kernel.U64(32))
    parts = []
    for cells, counts in rows:
        cut = np.searchsorted(cells >> kernel.U64(32), np.append(shards, shards[-1:] + 1)) if len(shards) else []
        parts.append((cells.astype(np.uint32), counts > 1, cut))

    def packed(k: slice) -> bytes:
        out = []
        for cells, twice, cut in parts:
            own = slice(cut[k.start], cut[k.start + 1])
            out += [np.diff(cells[own], prepend=np.uint32(0)), np.packbits(twice[own])]
        return pack(*out)

    yield from messages(piece, shards, packed)


def _merge_sketch(width: int):
    def run(shard: int, pieces: list[int], payloads: list[bytes]) -> list[bytes]:
        answers: list[list[np.ndarray]] = [[] for _ in payloads]
        for row in (0, 1):
            counts = np.zeros(width, np.uint8)
            cells = []
            for payload in payloads:
                gaps, twice = unpack(payload)[2 * row : 2 * row + 2]
                own = np.cumsum(gaps, dtype=np.uint32)
                counts[own] = np.minimum(counts[own] + 1 + np.unpackbits(twice, count=len(own)), 2)
                cells.append(own)
            for k, own in enumerate(cells):
                answers[k] += [np.packbits(counts[own] > 1), np.array([len(own)])]
        return [pack(*x) for x in answers]

    return run


def _bits(payloads: list[bytes] | None, part: int) -> np.ndarray:
    """Packed bits of all answers to a piece, one shard after another."""
    out = [np.zeros(0, np.uint8)]
    for payload in payloads or []:
        arrays = unpack(payload)
        out.append(np.unpackbits(arrays[2 * part], count=int(arrays[2 * part + 1][0])))
    return np.concatenate(out).astype(bool)


class Repeats:
    """Windows of a piece that the sketch estimates repeated, grouped by sequence."""

    def __init__(self, windows: Windows, payloads: list[bytes] | None):
        passed = np.ones(len(windows.a), bool)
        for row, cells in enumerate(windows.cells):
            if len(cells):
                passed &= _bits(payloads, row)[np.unique(cells, return_inverse=True)[1]]
        self.at = np.flatnonzero(passed)
        a, b = windows.a[self.at], windows.b[self.at]
        order = np.lexsort((b, a))  # stable: of equal windows the first stands first
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.a, self.b = a[new], b[new]
        self.first = self.at[order[new]]  # window of the first occurrence in the piece
        self.group = np.empty(len(a), np.int64)
        self.group[order] = np.cumsum(new) - 1


def _merge_exact(shard: int, pieces: list[int], payloads: list[bytes]) -> list[bytes]:
    parts = [unpack(p) for p in payloads]
    size = [len(p[0]) for p in parts]
    a, b, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
    # Pieces come in ascending order, so of equal ids the earlier piece is first.
    order = np.lexsort((np.repeat(np.arange(len(parts)), size), doc, b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.empty(len(a), bool)
    first[order] = new
    cut = np.concatenate([[0], np.cumsum(size)])
    return [pack(np.packbits(first[i:j]), np.array([j - i])) for i, j in zip(cut[:-1], cut[1:])]


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, piece_bytes: int = PIECE_BYTES, per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, text: one row per row of docs; text is the kept words joined by one space."""
    pieces = write_pieces(docs, piece_bytes)
    total = int(pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"])
    shards = -(-max(total, 1) // per_shard)
    width = 1 << int(np.ceil(np.log2(max(COUNTERS_PER_WINDOW * total / shards, 1024))))

    def windows(piece: Piece) -> Windows:
        return Windows(piece, window, shards, width)

    sketches = each_piece(pieces, lambda piece, row: _sketch(windows(piece), piece.id), MESSAGE)
    # Written, as both later passes read it.
    estimated = with_answers(pieces, materialise(merge(sketches, _merge_sketch(width)), "substring-sketch"), "repeated")

    def send(piece: Piece, row: dict) -> Iterator[pa.RecordBatch]:
        w = windows(piece)
        r = Repeats(w, row["repeated"])
        doc = piece.order[np.searchsorted(w.off, r.first, side="right") - 1]
        yield from messages(piece.id, shard_of(r.a, shards), lambda k: pack(r.a[k], r.b[k], doc[k]))

    exact = merge(each_piece(estimated, send, MESSAGE), _merge_exact)

    def cut(piece: Piece, row: dict) -> Iterator[pa.RecordBatch]:
        w = windows(piece)
        r = Repeats(w, row["repeated"])
        later = ~(_bits(row["first"], 0)[r.group] & (r.first[r.group] == r.at))
        gone = kernel.cover(len(w.start), w.at[r.at[later]], window)
        n = np.diff(w.word_off)
        upto = np.concatenate([[0], np.cumsum(gone)])
        n_gone = upto[w.word_off[1:]] - upto[w.word_off[:-1]]
        kept = np.flatnonzero(~gone)
        size = (w.end - w.start)[kept]
        end = np.cumsum(size + 1)  # each kept word is followed by one space
        text = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
        text[kernel.take_ranges(end - size - 1, size)] = piece.buf[kernel.take_ranges(w.start[kept], size)]
        bound = np.concatenate([[0], end])[w.word_off - upto[w.word_off]]
        raw = text.tobytes()
        texts = [raw[i : max(i, j - 1)] for i, j in zip(bound[:-1].tolist(), bound[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(piece.ids, pa.int64()), pa.array(n), pa.array(n_gone), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return each_piece(with_answers(estimated, exact, "first"), cut, "doc_id long, n_words long, n_removed long, text string")
