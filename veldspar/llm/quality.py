"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Words (lower-cased A-Z) and pairs of words are hashed to 2**BITS places; a document's features are its
counts at the places over the square root of their sum, so its score is a sparse dot product.
FTRL-proximal keeps per place the sums z and n, which fix its weight in closed form; L1 leaves rare places at zero.

Training reads a bounded sample: the MAX_SAMPLE labelled training rows of smallest hash of the id, a
documented limit; the weights (2**BITS floats) are what is broadcast, of a size fixed by BITS.  Scoring reads every whole text once and shuffles nothing.

Cases: null and blank texts have the bias only and get its score; a document with several labels
trains on its largest; without any labels scores are 0.5; repeated rows are scored each;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import filtered, ready, split_of

BITS = 18
MAX_SAMPLE = 3000
EPOCHS = 3
SEED = 5
#: What every pair of twice the same word hashes to, so that repetition is learnt whatever the word.
REPEAT = kernel.U64(0x9E3779B97F4A7C15)
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def features(column: pa.Array, hasher: kernel.Hasher, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice: hashed places of its documents' words and pairs, one document after another, and n + 1 offsets."""
    for _, _, buf, off in kernel.slices(column):
        low = kernel.LOWER[buf]
        start, end, woff = kernel.find_words(low, off, kernel.SPACE)
        hashes = hasher.words(low, start, end)
        at, goff = kernel.gram_starts(woff, 2)
        pairs = hasher.grams(hashes, at, 2)
        pairs[hashes[at] == hashes[at + 1]] = REPEAT
        out = np.empty(len(hashes) + len(pairs), np.int64)
        # A document's words come first, then its pairs.
        out[np.arange(len(hashes)) + np.repeat(goff[:-1], np.diff(woff))] = hashes >> kernel.U64(64 - bits)
        out[np.arange(len(pairs)) + np.repeat(woff[1:], np.diff(goff))] = pairs >> kernel.U64(64 - bits)
        yield out, woff + goff


def scores(column: pa.Array, weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    hasher = kernel.Hasher(SEED)
    out = [np.zeros(0)]
    for places, off in features(column, hasher, bits):
        n, dot = np.diff(off), np.full(len(off) - 1, bias)
        some = np.flatnonzero(n)
        if len(some):  # each document's sum is its own, so equal texts score alike whatever stands beside them
            dot[some] += np.add.reduceat(weights[places], off[:-1][some]) / np.sqrt(n[some])
        out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
    return np.concatenate(out)


def train(texts: pa.Array, labels: np.ndarray, *, bits: int = BITS, epochs: int = EPOCHS, rule: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal passes over the documents in a fixed shuffled order; the classes weigh the same in sum."""
    # Distinct places and counts of all documents in three flat arrays: documents as small arrays of their own would fragment the driver's memory.
    parts, ends = [], [np.zeros(1, np.int64)]
    for places, off in features(texts, kernel.Hasher(SEED), bits):
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        key, count = np.unique((doc << bits) | places, return_counts=True)
        parts.append(((key & ((1 << bits) - 1)).astype(np.int32), count.astype(np.float32)))
        ends.append(np.searchsorted(key >> bits, np.arange(1, len(off))) + ends[-1][-1])
    places = np.concatenate([np.zeros(0, np.int32), *[x[0] for x in parts]])
    counts = np.concatenate([np.zeros(0, np.float32), *[x[1] for x in parts]])
    at = np.concatenate(ends)
    del parts, ends
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    share = np.bincount(labels, minlength=2) / max(len(labels), 1)
    if len(labels) == 0 or share.min() == 0:  # nothing to tell apart
        return np.zeros(1 << bits), 0.0 if len(labels) == 0 else float(np.sign(share[1] - share[0]) * 5)
    order = np.random.default_rng(SEED)

    def weight(i: np.ndarray) -> np.ndarray:
        s = np.maximum(np.abs(z[i]) - rule.l1, 0)
        return -np.sign(z[i]) * s / ((rule.beta + np.sqrt(n[i])) / rule.alpha + rule.l2)

    for _ in range(epochs):
        for d in order.permutation(len(at) - 1):
            own = slice(at[d], at[d + 1])
            i = np.append(places[own], 1 << bits)  # the last place is the bias
            x = np.append(counts[own] / np.sqrt(max(counts[own].sum(), 1)), 1.0)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[d]) * x * 0.5 / share[labels[d]]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rule.alpha * w
            n[i] += g * g
    w = weight(np.arange((1 << bits) + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, max_sample: int = MAX_SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Train on at most max_sample labelled rows outside the held-out fold, those of smallest hash of the id."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(split_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)  # a top-k: no full sort
    chosen = F.broadcast(chosen)  # max_sample rows of two numbers at most
    found = docs.select("doc_id", "text").join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_sample)
    sample = found.toArrow()
    return train(sample["text"].combine_chunks(), sample["quality"].to_numpy().astype(np.int64).clip(0, 1), bits=bits)


def classify(docs: DataFrame, labels: DataFrame, *, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    weights, bias = fit(docs, labels, max_sample=max_sample)
    model = ready(docs.sparkSession).sparkContext.broadcast((weights.astype(np.float32), bias))
    rows = docs.select("doc_id", (split_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        w = w.astype(np.float64)
        for batch in batches:
            p = scores(batch.column(2), w, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is predicted to be good, with all their columns, in one pass over the texts."""
    weights, bias = fit(docs, labels)
    model = ready(docs.sparkSession).sparkContext.broadcast((weights.astype(np.float32), bias))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        w = w.astype(np.float64)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), w, b) >= 0.5))

    return filtered(docs, keep)
