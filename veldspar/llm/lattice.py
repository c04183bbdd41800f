"""Language-model scoring by subword lattices.

The pieces of a public subword vocabulary span a lattice over each word; every path is a segmentation, its
probability the product of its pieces' probabilities, and a forward recursion in log space sums them
all.  A text is its lower-cased words, each led by the vocabulary's word-start mark, and one end; as no path crosses a mark, its marginal
probability, the score, is the product of its words' marginals and the end's.  Any byte is also a piece, so every word has a path.

No public vocabulary at hand has unigram scores: the file is a BPE model, whose scores are minus the merge ranks.  1 / (rank + 50) gives the first probabilities, and
ROUNDS rounds of expectation-maximisation over the words of all training documents fit a unigram model's to them; with rounds=0 the ranks alone weight the segmentations.
Words are counted by shards of the word space (see pieces): every piece of
documents sends its distinct words with their training counts, shards add them up, run the recursion once per distinct word, and answer with
each word's count and marginal.  What reaches the driver is one number per vocabulary piece.

word_score is the score of a second, larger lattice, in which every training word is one more arc over its own bytes, of its share of all training
tokens, while that of words seen once goes to the vocabulary's arcs, which new words have alone (Good-Turing).

Words are found by 64-bit hash and are the same when their bytes are.  base_score is the add-one unigram score over words.

Cases: null texts count as empty and have the end only; a null id hashes as the empty text; ids are integers; repeated rows
are counted and scored each; without training documents every word is unknown; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import materialise, ready
from .pieces import MESSAGE, PIECE_BYTES, Piece, each_piece, merge, messages, pack, shard_of, unpack, with_answers, write_pieces

#: Of the public tokenizers; another file's path can be given.
VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
ROUNDS = 3
#: Distinct words of all pieces together that one shard counts, about: fewer than windows, as words are held as text.
WORDS_PER_SHARD = 1 << 19
MARK = "▁"
#: Added to the expected count of every piece, so that none becomes impossible.
FLOOR = 0.1
#: Words run through the recursion at one time, in bytes.
AT_ONCE = 1 << 20
SEED = 7


def load_vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, the mark as a space, and first log probabilities by the rank that the file's scores give; 256 bytes come last."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path(VOCABULARY))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if MARK in piece[1:]:
            continue
        found.setdefault(piece.replace(MARK, " ").encode(), model.get_score(i))
    names = sorted(found)
    rank = np.argsort(np.argsort([-found[x] for x in names], kind="stable")) + 1.0
    share = np.concatenate([1 / (rank + 50), np.full(256, 1e-6)])
    return names, np.log(share / share.sum())


class Lattice:
    """Trie of the pieces, and forward and backward recursions over many words side by side."""

    def __init__(self, names: list[bytes]):
        self.n = len(names)
        child: dict[int, int] = {}
        piece = [-1]
        for i, name in enumerate(names):
            node = 0
            for c in name:
                key = node * 256 + c
                if key not in child:
                    child[key] = len(piece)
                    piece.append(-1)
                node = child[key]
            piece[node] = i
        self.keys = np.array(sorted(child), np.int64)
        self.nodes = np.array([child[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.array(piece, np.int64)
        self.root = np.full(256, -1, np.int64)
        low = self.keys < 256
        self.root[self.keys[low]] = self.nodes[low]

    def _edges(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, length and piece of every vocabulary piece in every word, a word's bytes standing together."""
        end = np.repeat(off[1:], np.diff(off))
        at = np.arange(len(buf))
        node = self.root[buf]
        out = [(np.zeros(0, np.int64),) * 3]
        length = 1
        while len(at):
            live = node >= 0
            at, node = at[live], node[live]
            hit = self.piece[node] >= 0
            out.append((at[hit], np.full(hit.sum(), length), self.piece[node[hit]]))
            go = at + length < end[at]
            at, node = at[go], node[go]
            key = node * 256 + buf[at + length]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            node = np.where(self.keys[i] == key, self.nodes[i], -1)
            length += 1
        at = np.arange(len(buf))
        out.append((at, np.ones(len(buf), np.int64), self.n + buf.astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def run(self, buf: np.ndarray, off: np.ndarray, logp: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log marginal of each word; with weights also the expected count of each piece."""
        start, length, piece = self._edges(buf, off)
        word = np.repeat(np.arange(len(off) - 1), np.diff(off))
        node = start + word[start]  # each word has one more place between bytes than bytes
        place = start - off[word[start]]
        size = np.diff(off)
        begin = off[:-1] + np.arange(len(size))
        # Edges by place of their start, then by length and kind: within one step no two end in one node.
        kind = piece >= self.n
        order = np.lexsort((kind, length, place))
        node, length, piece, place, kind = node[order], length[order], piece[order], place[order], kind[order]
        new = np.ones(len(node), bool)
        new[1:] = (place[1:] != place[:-1]) | (length[1:] != length[:-1]) | (kind[1:] != kind[:-1])
        cut = np.append(np.flatnonzero(new), len(node))
        steps = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        lp = logp[piece]
        forward = np.full(len(buf) + len(size), -np.inf)
        forward[begin] = 0.0
        for s in steps:
            to = node[s] + length[s]
            forward[to] = np.logaddexp(forward[to], forward[node[s]] + lp[s])
        total = forward[begin + size]
        if weight is None:
            return total, None
        backward = np.full(len(buf) + len(size), -np.inf)
        backward[begin + size] = 0.0
        for s in reversed(steps):
            at = node[s]
            backward[at] = np.logaddexp(backward[at], backward[at + length[s]] + lp[s])
        owner = np.repeat(np.arange(len(size)), size + 1)[node]
        share = np.exp(forward[node] + lp + backward[node + length] - total[owner]) * weight[owner]
        return total, np.bincount(piece, share, self.n + 256)

    def batches(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        i, n = 0, len(off) - 1
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + AT_ONCE, side="right")) - 1))
            yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def _marked(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words one after another, each led by a space."""
    off = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(off[-1], 0x20, np.uint8)
    out[kernel.take_ranges(off[:-1] + 1, size)] = buf[kernel.take_ranges(start, size)]
    return out, off


def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS != HELD_OUT


class Counted:
    """Distinct words of a piece, in order of hash, and where its documents have them."""

    def __init__(self, piece: Piece):
        (hashes,), self.start, self.end, self.off = piece.words([kernel.Hasher(SEED)], lower=True)
        self.low = kernel.LOWER[piece.buf]
        self.first, self.place = kernel.exact_groups(hashes, self.low, self.start, self.end - self.start)
        self.words = hashes[self.first]
        self.doc = np.repeat(np.arange(len(piece.ids)), np.diff(self.off))
        self.training = np.array([is_training(x) for x in piece.ids], bool)


def _send(piece: Piece, shards: int) -> Iterator[pa.RecordBatch]:
    own = Counted(piece)
    counts = np.bincount(own.place[own.training[own.doc]], minlength=len(own.words)).astype(np.uint32)
    size = (own.end - own.start)[own.first]

    def packed(k: slice) -> bytes:
        return pack(own.words[k], counts[k], size[k].astype(np.uint32), own.low[kernel.take_ranges(own.start[own.first[k]], size[k])])

    yield from messages(piece.id, shard_of(own.words, shards), packed)


def _count(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Counts of the distinct words of a shard, their marked text and its offsets, and the places of each message's words among them."""
    parts = [unpack(p) for p in payloads]
    size = np.concatenate([p[2] for p in parts]).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    text = np.concatenate([p[3] for p in parts])
    first, place = kernel.exact_groups(np.concatenate([p[0] for p in parts]), text, start, size)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(first)).astype(np.int64)
    buf, off = _marked(text, start[first], size[first])
    return counts, buf, off, np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1])


@dataclass
class Fitted:
    """Log probabilities of pieces and of the end, training tokens, ends among them, distinct training words, and the share of words not yet seen."""

    logp: np.ndarray
    end: float
    n: int
    ends: int
    v: int
    new: float

    def with_word_arc(self, marginal: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log marginals over the vocabulary's arcs, of share new, and the word's own of its count in n training tokens."""
        with np.errstate(divide="ignore"):  # a word that was not counted has no arc
            own = np.log(counts * ((1 - self.new) / max(self.n, 1)))
        return np.logaddexp(own, np.log(self.new) + marginal)


def fit(sent: DataFrame, lattice: Lattice, logp: np.ndarray, rounds: int) -> Fitted:
    """The model of the training words; sent: messages of all pieces, ends are counted from shard -1."""
    spark = sent.sparkSession
    names = spark.sparkContext.broadcast(lattice)

    def words(table: pa.Table) -> pa.Table:
        counts, buf, off, _ = _count(table["payload"].to_pylist())
        known = counts > 0
        size = np.diff(off)[known]
        text = buf[kernel.take_ranges(off[:-1][known], size)]
        return pa.table({"n": pa.array([int(counts.sum())]), "v": pa.array([int(known.sum())]), "once": pa.array([int((counts == 1).sum())]), "payload": pa.array([pack(counts[known], size.astype(np.uint32), text)], pa.binary())})

    ends = sent.filter("shard < 0")
    vocabulary = materialise(sent.filter("shard >= 0").groupBy("shard").applyInArrow(words, "n long, v long, once long, payload binary"), "lattice-words")
    sums = vocabulary.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "v", "once")]).first()
    n_ends = int(ends.agg(F.coalesce(F.sum("piece"), F.lit(0)).alias("n")).first()["n"])
    n, v = int(sums["n"]) + n_ends, int(sums["v"]) + (n_ends > 0)
    end = np.log((n_ends + 1) / (n + 2))
    for _ in range(rounds if sums["n"] else 0):
        given = spark.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, lp = names.value, given.value
            total = np.zeros(model.n + 256)
            for batch in batches:
                for payload in batch.column("payload").to_pylist():
                    counts, size, text = unpack(payload)
                    off = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
                    for i, j, buf, part in model.batches(text, off):
                        total += model.run(buf, part, lp, counts[i:j].astype(np.float64))[1]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "x"])

        rows = vocabulary.mapInArrow(expect, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas()
        expected = np.full(len(logp), FLOOR)
        expected[rows["k"]] += rows["x"]
        logp = np.log(expected / (expected.sum() + n_ends + 1))
        end = np.log((n_ends + 1) / (expected.sum() + n_ends + 1))
    return Fitted(logp, float(end), n, n_ends, v, (int(sums["once"]) + 1) / (n + 1))


def score_texts(docs: DataFrame, *, vocabulary: str | None = None, rounds: int = ROUNDS, piece_bytes: int = PIECE_BYTES, per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score: one row per row of docs.

    vocabulary is the path of a sentencepiece model; by default one of the public tokenizers.
    """
    spark = ready(docs.sparkSession)
    pieces = write_pieces(docs, piece_bytes)
    total = int(pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"])
    shards = -(-max(total, 1) // (8 * per_shard))  # a piece's distinct words are about an eighth of its words
    names, first = load_vocabulary(vocabulary)
    lattice = Lattice(names)

    def send(piece: Piece, row: dict) -> Iterator[pa.RecordBatch]:
        yield from _send(piece, shards)
        ends = sum(map(is_training, piece.ids))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([ends], pa.int64()), pa.array([b""], pa.binary())], ["shard", "piece", "payload"])

    sent = materialise(each_piece(pieces, send, MESSAGE), "lattice-counts")
    fitted = fit(sent, lattice, first, rounds)
    model = spark.sparkContext.broadcast((lattice, fitted.logp))

    def answer(shard: int, ids: list[int], payloads: list[bytes]) -> list[bytes]:
        own, lp = model.value
        counts, buf, off, places = _count(payloads)
        marginal = np.concatenate([np.zeros(0), *[own.run(b, o, lp)[0] for _, _, b, o in own.batches(buf, off)]])
        return [pack(counts[p], marginal[p].astype(np.float32)) for p in places]

    answers = merge(sent.filter("shard >= 0"), answer)
    n, below, ends = fitted.n, np.log10(fitted.n + fitted.v + 1), fitted.ends
    fitted.logp = np.zeros(0)  # not needed where documents are scored

    def score(piece: Piece, row: dict) -> Iterator[pa.RecordBatch]:
        own = Counted(piece)
        docs_ = len(piece.ids)
        parts = [unpack(x) for x in row["answers"] or []]
        counts = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
        marginal = np.concatenate([np.zeros(0), *[p[1].astype(np.float64) for p in parts]])
        with_arc = fitted.with_word_arc(marginal, counts)[own.place]
        counts, marginal = counts[own.place], marginal[own.place]
        n_tokens = np.diff(own.off) + 1
        base = np.bincount(own.doc, np.log10(counts + 1.0), docs_) + np.log10(ends + 1.0) - n_tokens * below
        known = np.bincount(own.doc, counts > 0, docs_).astype(np.int64) + (ends > 0)
        end_arc = np.log((1 - fitted.new) * ends / max(n, 1) + fitted.new * np.exp(fitted.end))
        scores = [(np.bincount(own.doc, m, docs_) + e) / np.log(10) for m, e in ((marginal, fitted.end), (with_arc, end_arc))]
        columns = [pa.array(piece.ids, pa.int64()), pa.array(~own.training), pa.array(n_tokens), pa.array(known), pa.array(np.full(docs_, n)), pa.array(base), *map(pa.array, scores)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, word_score double"
    return each_piece(with_answers(pieces, answers, "answers"), score, schema)
