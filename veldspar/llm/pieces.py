"""Pieces: runs of whole documents packed into one row, and packed messages between pieces and key shards.

Operators that must look up every word or word window of the corpus would shuffle one row per
occurrence.  Instead documents are packed into pieces of about PIECE_BYTES, written once to the shared
folder as a table bucketed by piece.  Each piece sends every shard of the key space one packed message with its distinct
keys, pre-aggregated; a shard merges the messages of all pieces and answers each in the order of its keys;
the answers are joined to the pieces, which the bucketing keeps in place.  A key that stands in a
third of all documents costs one entry a piece, and no task sees more than its piece or its shard.

Pieces are read from the written table in every pass, so a lost executor's work is redone from the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import ready, scratch, shuffle_partitions

PIECE_BYTES = 4 << 20
#: Keys of all pieces together that one shard holds, about.
PER_SHARD = 1 << 21
MESSAGE = "shard long, piece long, payload binary"
MESSAGE_SCHEMA = pa.schema([("shard", pa.int64()), ("piece", pa.int64()), ("payload", pa.binary())])
NO_ID = -(2**63)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed buffer; bytes of the same significance stand together, which packs small numbers well."""
    head = [len(arrays)]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [ord(a.dtype.kind), a.dtype.itemsize, len(a)]
        body.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"")
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(payload: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(payload, np.int64, 1)[0])
    raw = pa.decompress(payload[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3)
    out, at = [], 8 + 24 * n
    for kind, width, count in head.tolist():
        flat = np.frombuffer(raw, np.uint8, width * count, at).reshape(width, count).T
        out.append(np.ascontiguousarray(flat).view(f"{chr(kind)}{width}").ravel())
        at += width * count
    return out


class Piece:
    """A packed row: ids and texts of its documents, in order of id."""

    def __init__(self, row: dict):
        self.id = row["piece"]
        self.ids = row["ids"]
        self.buf = np.frombuffer(row["texts"], np.uint8)
        self.off = np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])
        self.order = np.array([NO_ID if x is None else x for x in self.ids], np.int64)

    def words(self, hashers: list[kernel.Hasher], lower: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Hashes by each hasher, first byte, byte after the last of every word, and word offsets of the documents."""
        hashes, starts, ends, offs = [[np.zeros(0, np.uint64)] for _ in hashers], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        i, n = 0, len(self.off) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.off, self.off[i] + kernel.SLICE_BYTES, side="right")) - 1)
            buf = self.buf[self.off[i] : self.off[j]]
            buf = kernel.LOWER[buf] if lower else buf
            start, end, woff = kernel.find_words(buf, self.off[i : j + 1] - self.off[i], kernel.SPACE)
            for held, hasher in zip(hashes, hashers):
                held.append(hasher.words(buf, start, end))
            starts.append(start + self.off[i])
            ends.append(end + self.off[i])
            offs.append(woff[1:] + offs[-1][-1])
            i = j
        return ([np.concatenate(x) for x in hashes], *(np.concatenate(x) for x in (starts, ends, offs)))


def write_pieces(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """piece, n_words, ids, sizes, texts: the documents (doc_id, text) packed, in files of the shared folder bucketed by piece.

    Only a catalog table can be written in buckets, so one is made and its entry dropped at once.
    """
    spark = ready(docs.sparkSession)
    schema = "piece long, n_words long, ids array<long>, sizes array<int>, texts binary"
    arrow = pa.schema([("piece", pa.int64()), ("n_words", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array]] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            rows = pa.table({"id": pa.concat_arrays([x[0] for x in held]), "text": pa.concat_arrays([x[1] for x in held])})
            rows = rows.sort_by([("id", "ascending"), ("text", "ascending")]) if rows["id"].null_count == 0 else _nulls_first(rows)
            buf, off = kernel.string_buffer(rows["text"])
            n = len(kernel.find_words(buf, off, kernel.SPACE)[0]) if len(buf) < 4 * piece_bytes else int(np.count_nonzero(kernel.SPACE[buf]) + len(off))
            number += 1
            held, size = [], 0
            return pa.RecordBatch.from_pydict({"piece": [number], "n_words": [n], "ids": [rows["id"].to_pylist()], "sizes": [np.diff(off).astype(np.int32)], "texts": [buf.tobytes()]}, schema=arrow)

        for batch in batches:
            for i, j, buf, off in kernel.slices(batch.column(1), piece_bytes // 4):
                held.append((batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).fill_null("")))
                size += len(buf)
                if size >= piece_bytes or sum(len(x[0]) for x in held) >= 1 << 20:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    name = f"veldspar_pieces_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("compression", "zstd").option("path", scratch(spark, "pieces")).bucketBy(shuffle_partitions(spark), "piece").saveAsTable(name)
    pieces = spark.table(name)  # analysed here, with its buckets
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the files lie in the shared folder
    return pieces


def _nulls_first(rows: pa.Table) -> pa.Table:
    filled = rows["id"].combine_chunks().fill_null(NO_ID)
    order = pa.compute.sort_indices(pa.table({"id": filled, "text": rows["text"]}), [("id", "ascending"), ("text", "ascending")])
    return rows.take(order)


def each_piece(pieces: DataFrame, f: Callable[[Piece, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f of every piece and its row, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                yield from f(Piece(row), row)

    return pieces.mapInArrow(run, schema)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards in the order of the hashes: equal parts of the 64-bit range."""
    return ((hashes >> kernel.U64(32)) * kernel.U64(shards)) >> kernel.U64(32)


def messages(piece: int, shard: np.ndarray, pack_part: Callable[[slice], bytes]) -> Iterator[pa.RecordBatch]:
    """A message per shard that occurs in the ascending array; pack_part packs a part of the piece's keys."""
    found, first = np.unique(shard, return_index=True)
    last = np.append(first[1:], len(shard))
    if len(found):
        payload = [pack_part(slice(a, b)) for a, b in zip(first.tolist(), last.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.full(len(found), piece)), pa.array(payload, pa.binary())], schema=MESSAGE_SCHEMA)


def merge(sent: DataFrame, f: Callable[[int, list[int], list[bytes]], list[bytes]]) -> DataFrame:
    """Answers (shard, piece, payload): f of each shard's messages, one answer to each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        shard = table["shard"][0].as_py()
        answers = f(shard, table["piece"].to_pylist(), table["payload"].to_pylist())
        return pa.table([table["shard"], table["piece"], pa.array(answers, pa.binary())], schema=MESSAGE_SCHEMA)

    return sent.groupBy("shard").applyInArrow(run, MESSAGE)


def with_answers(pieces: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """pieces with a column of the payloads of its answers in order of shard; the pieces stay where they are."""
    own = answers.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("shard", "payload"))).alias(name))
    own = own.select("piece", F.transform(name, lambda x: x["payload"]).alias(name))
    return pieces.join(own.hint("shuffle_hash"), "piece", "left")
