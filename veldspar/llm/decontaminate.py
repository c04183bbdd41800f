"""Benchmark decontamination by winnowing.

Words are runs of letters and digits, lower-cased A-Z.  A window is WINDOW consecutive words of one
item; an item of fewer words is one window.  Of the hashes of K consecutive words the least in each
W consecutive ones, the last of several as small, is kept as a fingerprint, in documents and items alike.  With K + W - 1 = WINDOW every shared
span of WINDOW words holds a shared fingerprint at the same place.  A document's fingerprints are joined with the items';
each match is extended to all windows over it, which are compared with the items' windows, first by hash and then byte by byte, and neighbouring windows
that match make up the extended span.  A window is compared once however many places of items it matches, so time grows with the words of the
document, not with pairs of places.  Short items are matched by the hash of all their words, which is winnowing with K as long as the item and W = 1.

Documents are not shuffled.  The items are taken in blocks of at most BLOCK_BYTES of text, a proven bound on what is broadcast:
with more than one block they are taken one after another, each block's spans are written and its broadcast is destroyed before the
next one is built, and the spans are merged by document.

Cases: null and wordless texts have no words and no hits; null and wordless items have no windows; several rows of one item_id
are parts of one item, each with its own windows, a null item_id is the id ''; repeated document rows are judged each; empty tables give empty
results or no hits; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import filtered, free_name, materialise, ready, without

WINDOW = 13
K = 7
W = WINDOW - K + 1
BLOCK_BYTES = 16 << 20
SEED = 6
#: A document is contaminated if at least one in RATIO words is hit.
RATIO = 20


def winnow(grams: np.ndarray, gram_off: np.ndarray) -> np.ndarray:
    """Which grams are fingerprints: in each W consecutive ones of a document the last that is the least."""
    first, _ = kernel.gram_starts(gram_off, W)
    keep = np.zeros(len(grams), bool)
    if not len(first):
        return keep
    least, last = grams[first], np.zeros(len(first), np.int64)
    for d in range(1, W):
        now = grams[first + d]
        last[now <= least] = d
        least = np.minimum(least, now)
    keep[first + last] = True
    return keep


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and offsets into the distinct values of each."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    keys, values = keys[new], values[new]
    distinct, first = np.unique(keys, return_index=True)
    return distinct, np.append(first, len(keys)), values


class Index:
    """Fingerprints, windows and short items of a block of items, under the first seed by which no two different windows have one hash."""

    def __init__(self, ids: list[str], texts: pa.Array):
        self.ids = np.array(ids, dtype=object)
        bufs, starts, ends, offs = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        base = 0
        for _, _, buf, off in kernel.slices(texts):
            low = kernel.LOWER[buf]
            start, end, woff = kernel.find_words(low, off, kernel.NOT_ALNUM)
            bufs.append(low)
            starts.append(start + base)
            ends.append(end + base)
            offs.append(woff[1:] + offs[-1][-1])
            base += len(low)
        self.buf, self.start, off = np.concatenate(bufs), np.concatenate(starts), np.concatenate(offs)
        self.size = np.concatenate(ends) - self.start
        seed = SEED
        while not self._built(kernel.Hasher(seed), off):
            seed += 1

    def _built(self, hasher: kernel.Hasher, off: np.ndarray) -> bool:
        self.hasher = hasher
        hashes = hasher.words(self.buf, self.start, self.start + self.size)
        _, word = kernel.exact_groups(hashes, self.buf, self.start, self.size)  # numbers of words by their bytes
        at, goff = kernel.gram_starts(off, K)
        grams = hasher.grams(hashes, at, K)
        self.prints = np.unique(grams[winnow(grams, goff)])
        # Windows by hash, the items that have each, and one place of each; then the short items in the same way.
        at, woff = kernel.gram_starts(off, WINDOW)
        size = np.diff(off)
        parts = [(WINDOW, at, np.repeat(np.arange(len(self.ids)), np.diff(woff)))]
        parts += [(n, off[:-1][size == n], np.flatnonzero(size == n)) for n in sorted({int(x) for x in size if 0 < x < WINDOW})]
        self.windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n, at, items in parts:
            keys = hasher.grams(hashes, at, n)
            found, first, group = np.unique(keys, return_index=True, return_inverse=True)
            place = at[first]
            if any((word[at + d] != word[place[group] + d]).any() for d in range(n)):
                return False
            self.windows.append((n, *_grouped(keys, items), place))
        return True

    def same(self, begin: np.ndarray, place: np.ndarray, n: int, text: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Which of the runs of n words of the text that begin at `begin` have the bytes of the index's from `place` on."""
        buf, start, end = text
        left = np.arange(len(begin))
        for d in range(n):
            i, j = begin[left] + d, place[left] + d
            left = left[kernel.same_bytes(buf, start[i], end[i] - start[i], self.buf, self.start[j], self.size[j])]
        return left

    def hits(self, hashes: np.ndarray, off: np.ndarray, text: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of hit spans, in words of all documents, and distinct pairs of a document and an item (row of the block).

        text: bytes, and first byte and byte after the last of every word.
        """
        starts, lengths, docs, items = ([np.zeros(0, np.int64)] for _ in range(4))

        def add(at: np.ndarray, place: np.ndarray, n: int, to: np.ndarray, of: np.ndarray) -> None:
            """Windows of n words that begin at `at` (ascending) and match the index's window `place`."""
            if not len(at):
                return
            doc = np.searchsorted(off, at, side="right") - 1
            joined = np.flatnonzero(np.append(True, (at[1:] > at[:-1] + 1) | (doc[1:] > doc[:-1])))
            last = np.append(joined[1:], len(at)) - 1
            starts.append(at[joined])
            lengths.append(at[last] + n - at[joined])
            key = np.unique(doc * len(to) + place)
            doc, place = key // len(to), key % len(to)
            count = to[place + 1] - to[place]
            docs.append(np.repeat(doc, count))
            items.append(of[kernel.take_ranges(to[place], count)])

        at, goff = kernel.gram_starts(off, K)
        for n, windows, to, of, places in self.windows:
            if n < WINDOW:
                begin, _ = kernel.gram_starts(off, n)
            elif len(at) and len(self.prints):
                grams = self.hasher.grams(hashes, at, K)
                own = np.flatnonzero(winnow(grams, goff))
                own = own[self.prints[np.minimum(np.searchsorted(self.prints, grams[own]), len(self.prints) - 1)] == grams[own]]
                # Extended to all windows over a matching fingerprint that lie in its document.
                around = np.zeros(len(hashes) + 1, bool)
                for d in range(W):
                    before = at[own] - d
                    around[before[before >= 0]] = True
                whole, _ = kernel.gram_starts(off, WINDOW)
                begin = whole[around[whole]]
            else:
                continue
            h = self.hasher.grams(hashes, begin, n)
            window = np.minimum(np.searchsorted(windows, h), len(windows) - 1)
            alike = np.flatnonzero(windows[window] == h)
            alike = alike[self.same(begin[alike], places[window[alike]], n, text)]
            add(begin[alike], window[alike], n, to, of)
        return tuple(np.concatenate(x) for x in (starts, lengths, docs, items))


def _spans(column: pa.Array, index: Index) -> Iterator[tuple[np.ndarray, ...]]:
    """Per slice: words of each document; document, start in it and length of each hit span; document and item of each distinct pair."""
    for _, _, buf, off in kernel.slices(column):
        low = kernel.LOWER[buf]
        first, last, woff = kernel.find_words(low, off, kernel.NOT_ALNUM)
        start, length, docs, items = index.hits(index.hasher.words(low, first, last), woff, (low, first, last))
        doc = np.searchsorted(woff, start, side="right") - 1
        yield np.diff(woff), doc, start - woff[doc], length, docs, index.ids[items]


def _judge(n_words: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[str], list[int]]:
    """n_hit, comma-joined item ids, and n_items of each document of a slice."""
    off = np.concatenate([[0], np.cumsum(n_words)])
    hit = np.concatenate([[0], np.cumsum(kernel.cover(off[-1], off[doc] + start, length))])
    n_hit = hit[off[1:]] - hit[off[:-1]]
    items: list[set] = [set() for _ in n_words]
    for d, i in zip(docs.tolist(), ids.tolist()):
        items[d].add(i)
    return n_hit.tolist(), [",".join(sorted(x)) for x in items], [len(x) for x in items]


COLUMNS = "n_words long, n_hit long, n_items long, items string, items_sha256 string, contaminated boolean"


def _columns(n_words: np.ndarray, n_hit: list[int], items: list[str], n_items: list[int]) -> list[pa.Array]:
    hit, n = np.array(n_hit, np.int64), np.asarray(n_words, np.int64)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in items]
    return [pa.array(n), pa.array(hit), pa.array(n_items, pa.int64()), pa.array(items, pa.string()), pa.array(sha, pa.string()), pa.array((hit > 0) & (RATIO * hit >= n))]


def _joined(parts: list[list[pa.Array]], n: int) -> list[pa.Array]:
    return [pa.concat_arrays(x) for x in zip(*parts)] if parts else _columns(np.zeros(0), [], [], [])


def _blocks(bench: DataFrame, block_bytes: int) -> tuple[int, Callable[[int], Index]]:
    """Number of blocks of the items, each of about block_bytes of text at most, and what builds a block's index."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))

    def build(k: int) -> Index:
        rows = items.filter(block == k).orderBy("item_id", "text").toArrow()
        return Index(rows["item_id"].to_pylist(), rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()))

    return n, build


def contamination(docs: DataFrame, bench: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated: one row per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    judged = _judged(docs.select("doc_id", F.col("text").cast("string").alias("text")), bench, block_bytes, 1, keep=False)
    return judged.select(F.col("doc_id").cast(kind), *[x.split()[0] for x in COLUMNS.split(", ")])


def decontaminate(docs: DataFrame, bench: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    return _judged(docs, bench, block_bytes, docs.columns.index("text"), keep=True)


def _judged(docs: DataFrame, bench: DataFrame, block_bytes: int, at: int, *, keep: bool) -> DataFrame:
    spark = ready(docs.sparkSession)
    n_blocks, build = _blocks(bench, block_bytes)
    names = ["doc_id", *[x.split()[0] for x in COLUMNS.split(", ")]]

    def answer(batch: pa.RecordBatch, columns: list[pa.Array]) -> pa.RecordBatch:
        if keep:
            return batch.filter(pa.array(~columns[-1].to_numpy(zero_copy_only=False).astype(bool)))
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    if n_blocks == 1:
        given = spark.sparkContext.broadcast(build(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = given.value
            for batch in batches:
                parts = [_columns(found[0], *_judge(*found)) for found in _spans(batch.column(at), index)]
                yield answer(batch, _joined(parts, len(batch)))

        return filtered(docs, run) if keep else docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")

    # More blocks than one: spans of each block by row of a fixed copy, merged.
    row_id = free_name(docs.columns, "_row")
    fixed = materialise(docs.withColumn(row_id, F.monotonically_increasing_id()), "decontaminate-docs")
    part_schema = "_row long, n_words long, starts array<long>, lengths array<long>, items array<string>"
    every = None
    for k in range(n_blocks):
        every_row = k == 0  # one block tells how many words each document has, the others speak of hits only
        given = spark.sparkContext.broadcast(build(k))

        def spans(batches: Iterator[pa.RecordBatch], given=given, every_row=every_row) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                base, out = 0, []
                row = batch.column(1).to_pylist()
                for n_words, doc, start, length, docs_, ids in _spans(batch.column(0), given.value):
                    by_doc, by_item = np.argsort(doc, kind="stable"), np.argsort(docs_, kind="stable")
                    cut, item_cut = np.searchsorted(doc[by_doc], np.arange(len(n_words) + 1)), np.searchsorted(docs_[by_item], np.arange(len(n_words) + 1))
                    start, length, ids = start[by_doc], length[by_doc], ids[by_item]
                    for d in range(len(n_words)):
                        c, i = slice(cut[d], cut[d + 1]), slice(item_cut[d], item_cut[d + 1])
                        if every_row or c.stop > c.start:
                            out.append({"_row": row[base + d], "n_words": int(n_words[d]), "starts": start[c].tolist(), "lengths": length[c].tolist(), "items": ids[i].tolist()})
                    base += len(n_words)
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_row", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

        own = materialise(fixed.select("text", F.col(row_id).alias("_row")).mapInArrow(spans, part_schema), "decontaminate-spans")
        given.destroy()
        every = own if every is None else every.unionByName(own)
    merged = every.groupBy("_row").agg(F.first("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "lengths", "items")])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for x in batch.to_pylist():
                spans_, ids = np.zeros(len(x["starts"]), np.int64), np.zeros(len(x["items"]), np.int64)
                n = np.array([x["n_words"]])
                parts.append(_columns(n, *_judge(n, spans_, np.array(x["starts"], np.int64), np.array(x["lengths"], np.int64), ids, np.array(x["items"], dtype=object))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_joined(parts, len(batch))], ["_row", *[c.split()[0] for c in COLUMNS.split(", ")]])

    verdict = merged.mapInArrow(finish, f"_row long, {COLUMNS}")
    if keep:
        gone = materialise(verdict.filter("contaminated").select(F.col("_row").alias(row_id)), "decontaminate-gone")
        return without(fixed, row_id, gone).drop(row_id)
    return fixed.select(F.col(row_id).alias("_row"), "doc_id").join(verdict, "_row").select(*names)
